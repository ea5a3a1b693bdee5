"""Functions of the depot engine."""
