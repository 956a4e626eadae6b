"""Plans of several operators."""
