"""Retention operators: each a DataFrame -> DataFrame function."""
