"""Registered queries and the rasters that they run on."""
