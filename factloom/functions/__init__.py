"""Functions of the fact engine."""
