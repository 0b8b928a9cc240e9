"""Operators for large-scale text and key collections. Nothing else in siltbed imports this subpackage."""
