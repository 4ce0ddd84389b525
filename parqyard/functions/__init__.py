"""Decoding, statistics and formatting."""
