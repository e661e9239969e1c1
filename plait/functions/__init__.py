"""Column functions over bases, signatures and counts."""
