"""Decoding of files as they arrive."""
