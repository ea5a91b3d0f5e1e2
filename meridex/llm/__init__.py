"""Operators for preparing text corpora: media, quality, privacy, filtering, deduplication, scoring and packing."""
