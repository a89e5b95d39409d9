"""Training-data operators: extraction, search, token output, dedup, mixing, filtering, packing and quality."""
