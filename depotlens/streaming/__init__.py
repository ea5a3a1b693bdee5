"""Streaming of the depot engine."""
