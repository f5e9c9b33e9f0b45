"""Readers, ingest, sinks and export formats."""
