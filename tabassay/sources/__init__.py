"""Readers, the dataset manifest, sampling and sinks."""
