"""Scans, sinks and snapshot storage."""
