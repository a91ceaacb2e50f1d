"""Operators for preparing training text, each with its query."""
