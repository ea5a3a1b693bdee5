"""Plans of the depot engine."""
