"""Operators for preparing training corpora: quality, deduplication, decontamination, tokens, sharding, archives."""
