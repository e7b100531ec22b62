"""Operators for text and source corpora."""
