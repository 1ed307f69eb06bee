"""Training-data operators: deduplication, filtering, extraction, packing."""
