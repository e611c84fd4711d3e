"""Column expressions: predicates and rewrites."""
