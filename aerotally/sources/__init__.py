"""Readers and writers of the formats the library exchanges."""
