"""Column functions on text and on JSON."""
