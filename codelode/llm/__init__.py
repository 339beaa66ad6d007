"""Operators on corpora of text and code."""
