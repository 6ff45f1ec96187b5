"""Operators for text corpora: cleaning, labelling, deduplication, tokenising and archives."""
