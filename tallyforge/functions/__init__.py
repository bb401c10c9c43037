"""Column expressions for cleaning text, numbers and preference arrays."""
