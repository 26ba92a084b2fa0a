"""Operators for training-data pipelines: chat repair, language, toxicity, dedup, licences, mixing, leaks, search, shards."""
