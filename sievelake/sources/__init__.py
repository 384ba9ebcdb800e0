"""Readers of the file shapes."""
