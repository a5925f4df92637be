"""Image files as sources and sinks."""
