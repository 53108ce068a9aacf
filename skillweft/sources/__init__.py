"""Readers, upserts and report sinks."""
