"""Column functions: text, vectors, numbers."""
