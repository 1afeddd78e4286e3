"""Readers and writers of results files and series files."""
