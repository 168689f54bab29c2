"""Training-data operators: dedup, filtering, sharding, tokenising and archives."""
