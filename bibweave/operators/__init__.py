"""operators of bibweave."""
