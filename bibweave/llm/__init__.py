"""Operators for preparing training data. Nothing else in bibweave imports this subpackage."""
