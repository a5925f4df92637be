"""Operators on pixel relations (image_id, x, y, channels)."""
