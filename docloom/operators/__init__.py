"""Document, chunk, retrieval, answer and evaluation operators (DataFrame to DataFrame)."""
