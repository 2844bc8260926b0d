"""Operators for training text and nearest-time matching; nothing else in the library imports this package."""
