"""Column expressions and size-bounded building blocks."""
