"""Reports and written results."""
