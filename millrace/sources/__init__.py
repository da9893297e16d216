"""Readers for batch tables, files, topics and change feeds."""
