"""Operators for preparing training data: dedup, filtering, mixing, packing, token files."""
