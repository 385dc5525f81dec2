"""Column expressions: predicates, text typing, numbers, display text."""
