"""Sinks: files, tables, keyed upserts, output layout."""
