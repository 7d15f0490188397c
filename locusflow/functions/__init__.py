"""Column functions over genotype arrays."""
