"""Corpus readers and the stored form of an index."""
