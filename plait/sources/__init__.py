"""Readers and writers of the text formats, and a seeded simulator."""
