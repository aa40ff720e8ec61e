"""Relational operators over training-data tables."""
