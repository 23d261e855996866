"""Structured Streaming forms of the incremental behaviours. Each returns a streaming DataFrame or a started query."""
