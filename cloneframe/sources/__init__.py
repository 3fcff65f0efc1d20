"""Readers of sequencing exports and writers of results."""
