"""Operators of a training-data pipeline: archives, sharding, token files, quality, tokenizing, near copies, packing, lines, toxicity, search."""
