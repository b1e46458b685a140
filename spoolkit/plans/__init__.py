"""Queries over the standard tables, built from the operators."""
