"""Preparation of training data: sharding, mixing, near duplicates, search, quality, packing, fixity, toxicity, secrets, set joins."""
