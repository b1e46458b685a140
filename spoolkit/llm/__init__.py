"""Operators for training corpora; nothing else in the library imports this."""
