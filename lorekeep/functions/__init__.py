"""Column expressions: text, names, paths, vectors."""
