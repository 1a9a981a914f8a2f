"""Operators that prepare training data: quality, near-duplicates, personal data, mixing, packing, search."""
