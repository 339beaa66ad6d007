"""Column functions: texts, paths, predicates and rules."""
