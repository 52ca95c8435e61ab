"""Operators on the text of pages, notes and messages for building training corpora."""
