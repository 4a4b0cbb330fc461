"""Operators for training-data pipelines: scans, extraction, deduplication, classification and tokenisation."""
