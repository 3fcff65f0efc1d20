"""Column functions: sequences, statistics and pairwise metrics."""
