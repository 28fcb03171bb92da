"""Training-data operators: sharding, search, mixing, extraction, scans, chat, packing, toxicity and deduplication."""
