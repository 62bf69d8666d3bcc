"""Training-data operators: language, quality, archives, tokens, search, packing and deduplication."""
