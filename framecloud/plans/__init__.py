"""Whole builds composed from operators."""
