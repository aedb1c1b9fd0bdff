"""Column expressions: taxonomy, numbers, scorers and texts."""
