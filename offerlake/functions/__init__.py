"""Column functions: text, numbers, URLs, similarity, JSON and HTML."""
