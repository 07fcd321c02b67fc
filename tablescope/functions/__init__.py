"""Column expressions and schema helpers shared by the operators."""
