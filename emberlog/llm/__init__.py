"""Training-data operators: quality rules, deduplication, language ID, tokens, search, mixing, packing."""
