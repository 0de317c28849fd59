"""Streaming of the fact engine."""
