"""Operators for large-scale training data: near-dedup, formatting, language, packing and more."""
