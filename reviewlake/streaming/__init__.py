"""Streaming refresh."""
