"""Operators for preparing text for model training. Nothing else in the library imports this subpackage."""
