"""Column functions: time, text and price."""
