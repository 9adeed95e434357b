"""Operators of a training-data pipeline; nothing else in terrace imports this."""
