"""plans of bibweave."""
