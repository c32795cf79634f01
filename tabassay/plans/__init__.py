"""Composites that share scans between operators."""
