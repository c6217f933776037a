"""Operators that turn the store's texts into training data."""
