"""Training-data operators: near-duplicates, language, toxicity, mixing, sharding, search and token files."""
