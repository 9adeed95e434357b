"""Plans of the terrace engine."""
