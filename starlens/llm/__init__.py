"""Operators for large training-data corpora; nothing else in the package depends on them."""
