"""Whole loads and reports composed from the operators."""
