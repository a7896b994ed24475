"""Readers of files and tables, and writers of results."""
