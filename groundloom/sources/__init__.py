"""Scans, sinks and file-level bookkeeping."""
