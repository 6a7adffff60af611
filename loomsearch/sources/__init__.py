"""Readers and writers: article fragments, sitemaps, index text, tables."""
