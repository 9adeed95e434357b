"""Sources of the terrace engine."""
