"""Morphological analysis as DataFrame operations."""
