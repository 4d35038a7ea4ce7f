"""Operators for large text corpora: language ID, deduplication, filters, packing and shard writing."""
