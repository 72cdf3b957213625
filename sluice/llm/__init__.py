"""Training-data operators: scoring, deduplication, mixing, sharding, packing."""
