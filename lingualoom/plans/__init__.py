"""Whole jobs composed from operators, and the catalogue of registered queries."""
