"""Whole query plans composed from the operators."""
