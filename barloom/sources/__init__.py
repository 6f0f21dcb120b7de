"""Readers, cleaning steps and sinks."""
