"""Readers and sinks."""

from knotwork.sources.tables import table, version

__all__ = ["table", "version"]
