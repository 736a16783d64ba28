"""Operators for training-data work on texts; nothing else in the library imports them."""
