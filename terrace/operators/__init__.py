"""Operators of the terrace engine."""
