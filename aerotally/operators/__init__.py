"""Operators: ``DataFrame -> DataFrame`` transformations."""
