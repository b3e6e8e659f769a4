"""Operators for training data: duplicates, quality, private data, tokens, packing, search."""
