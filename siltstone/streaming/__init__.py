"""Streams of changes and events."""
