"""Column functions on text, HTML and URLs."""
