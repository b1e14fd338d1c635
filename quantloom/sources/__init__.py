"""Readers, bar derivation, calendars, caches and sinks."""
