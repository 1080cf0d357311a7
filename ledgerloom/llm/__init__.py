"""Operators for corpora of texts, pages, conversations and vectors."""
