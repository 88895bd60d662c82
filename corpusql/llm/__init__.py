"""Training-data operators: quality, near-duplicates, contamination, secrets, packing and more."""
