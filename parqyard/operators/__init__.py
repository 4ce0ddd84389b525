"""Filters and tables."""
