"""Operators for preparing training data: URL filters, searches, deduplication, tokens, archives, mixtures."""
