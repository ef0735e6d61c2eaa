"""Column expressions and grouping helpers shared by all operators."""
