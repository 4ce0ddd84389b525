"""Filters over streams."""
