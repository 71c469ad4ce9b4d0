"""Readers, ingest reductions and sinks."""
