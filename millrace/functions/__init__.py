"""Column helpers: time, JSON, text and keyword extraction."""
