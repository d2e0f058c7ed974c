"""Operators for large training corpora: filters, near-duplicates, sharding,
mixing, tokens.  Nothing outside this package imports it."""
