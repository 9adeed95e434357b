"""Streaming of the terrace engine."""
