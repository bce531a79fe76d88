"""Chunk-by-chunk jobs as Structured Streaming queries."""
