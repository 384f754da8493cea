"""Stored tables in buckets, a stored full-text index, and the code index that is made of them."""
