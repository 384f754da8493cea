"""Training-data operators: scoring, packing, deduplication, search, tokenisation.

Nothing else in the library imports this subpackage.
"""
