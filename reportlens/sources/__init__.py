"""Scans, sinks and tables derived from the given ones."""
