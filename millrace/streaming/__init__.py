"""Chunked ingest and windowed aggregates over streams."""
