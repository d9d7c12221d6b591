"""Whole workflows composed from operators."""
