"""Operators of the depot engine."""
