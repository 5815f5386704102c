"""Column functions: text, numbers, replies."""
