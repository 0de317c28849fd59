"""Operators of the fact engine."""
