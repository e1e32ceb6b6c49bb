"""Comparison operators, each a composition of DataFrame operations."""
