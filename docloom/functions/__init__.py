"""Column functions: text, spans with offsets, vectors."""
