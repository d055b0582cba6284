"""Column expressions and geometry functions."""
