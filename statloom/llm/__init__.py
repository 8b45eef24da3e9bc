"""Operators for training-data corpora: deduplication, filters, archives, sharding, mixing and packing."""
