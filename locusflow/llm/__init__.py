"""Operators for large training-text corpora, each a function from DataFrame to DataFrame."""
