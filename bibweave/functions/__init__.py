"""functions of bibweave."""
