"""Training-data operators: scoring, filtering, deduplication, tokenising and packing of text corpora.

Nothing outside this package imports it.
"""
