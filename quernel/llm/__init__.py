"""Operators for preparing training data: packing, counting, extraction, sharding, mixing, media, dedup, search, quality."""
