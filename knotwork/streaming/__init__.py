"""Incremental ingest of edge records."""

from knotwork.streaming.ingest import edge_stream, merged_counts

__all__ = ["edge_stream", "merged_counts"]
