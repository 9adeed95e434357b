"""Functions of the terrace engine."""
