"""Training-data operators: quality, safety, near-duplicates, mixing, packing,
archives, search and chat formatting. Nothing else in the library imports it."""
