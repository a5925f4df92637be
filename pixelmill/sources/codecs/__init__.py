"""Kernels between bytes and arrays; no Spark in here."""
