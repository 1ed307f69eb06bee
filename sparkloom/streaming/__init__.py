"""Replicates that arrive over time."""
