"""Operators for large text and score tables; nothing else in the package imports this subpackage."""
