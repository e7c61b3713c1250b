"""Column functions over vectors, scalars and strings."""
