"""Column functions: scalars, predicates and period resolution."""
