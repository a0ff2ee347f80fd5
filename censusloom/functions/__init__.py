"""Column expressions and the bounded p-value functions."""
