"""Column expressions: text clean-up, paths, HTML to text, report lines."""
