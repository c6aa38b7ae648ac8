"""Column expressions and small summaries shared by the operators."""
