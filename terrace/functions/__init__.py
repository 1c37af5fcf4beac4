"""Column functions of one pixel."""
