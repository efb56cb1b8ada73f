"""functions of the lexloom engine."""
