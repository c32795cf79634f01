"""Operators for preparing text corpora, vectors and web pages as training data."""
