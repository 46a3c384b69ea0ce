"""Column functions: names, rounding, vectors, and image metrics."""
