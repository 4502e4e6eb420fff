"""Whole screenings composed from the operators."""
