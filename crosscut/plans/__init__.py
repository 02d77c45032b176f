"""Whole analyses composed of operators, and the catalogue of checked queries."""
