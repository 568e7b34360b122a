"""Journals and heads as streams."""
