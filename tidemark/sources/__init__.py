"""Scans, sinks, incremental tables and payload shapes."""
