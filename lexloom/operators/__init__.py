"""operators of the lexloom engine."""
