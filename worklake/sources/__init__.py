"""Readers of source extracts and writers of tables."""
