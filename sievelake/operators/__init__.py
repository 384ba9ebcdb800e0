"""Relational operators of retrieval analytics."""
