"""Normalisers: one projection per platform entity, nested record to flat row."""
