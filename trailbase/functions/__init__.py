"""Column functions: URLs, text, scores, dates and JSON."""
