"""Stateful sentence segmentation and incremental ingest."""
