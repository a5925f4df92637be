"""A raster analytics engine on Spark: images are relations of pixels."""
