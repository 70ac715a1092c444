"""sources of bibweave."""
