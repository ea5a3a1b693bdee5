"""Sources of the depot engine."""
