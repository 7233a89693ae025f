"""Training-data operators: language id, token shards, dedup, decontamination and search."""
