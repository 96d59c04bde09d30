"""Training-data operators: search, filtering, formatting, deduplication, mixing and packing."""
