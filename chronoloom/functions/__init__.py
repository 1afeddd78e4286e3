"""Column functions over series held as arrays."""
