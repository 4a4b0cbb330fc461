"""Scans, sinks and tables in the shared folder."""
