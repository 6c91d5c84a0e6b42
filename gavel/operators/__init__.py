"""Relational, sequence, graph, text and vector operators over DataFrames."""
