"""Readers and writers of citations, articles and results."""
