"""Sources of the fact engine."""
