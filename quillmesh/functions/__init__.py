"""Column functions over Markdown text and headers."""
