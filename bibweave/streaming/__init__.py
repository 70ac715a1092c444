"""streaming of bibweave."""
