"""Operators over text corpora: deduplication, scoring, extraction, packing and search."""
