"""Readers, writers and the staging of intermediate tables."""
