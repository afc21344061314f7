"""Schemas, lookups, readers and writers."""
