"""Readers, writers and the daily panels derived from the driver tables."""
