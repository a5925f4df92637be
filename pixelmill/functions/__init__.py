"""Column builders: colour models and rectangle geometry."""
