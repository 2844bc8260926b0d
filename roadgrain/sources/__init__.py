"""Readers and writers."""

from roadgrain.sources.tables import table

__all__ = ["table"]
