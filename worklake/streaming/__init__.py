"""Incremental pick-up of landed extracts."""
