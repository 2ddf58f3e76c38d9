"""Compositions of operators, and views of the given tables."""
