"""Operators for preparing training text, each with its own module, and their named queries."""
