"""Column expressions and dense numerics."""
