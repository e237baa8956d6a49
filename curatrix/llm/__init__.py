"""Operators for large-scale text-corpus pipelines; nothing else in the library imports this package."""
