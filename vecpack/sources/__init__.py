"""Persistent indexes and record files."""
