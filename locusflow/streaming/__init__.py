"""Variants that arrive as files: bounded streams with the batch operators."""
