"""Operators for large training corpora: dedup, fingerprints, filters, mixing, tokenising and media columns."""
