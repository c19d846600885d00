"""Operators on training and evaluation text. Nothing else in the library imports this package."""
