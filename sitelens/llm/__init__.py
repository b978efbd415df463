"""Training-data operators: sharding, language, tokens, near and exact duplicates, filters."""
