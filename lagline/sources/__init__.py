"""Schemas, raw files, dataset adapters and sinks."""
