"""Spark jobs for divergence analytics over trees, matrices and score tables."""
