"""Column functions and table helpers."""
