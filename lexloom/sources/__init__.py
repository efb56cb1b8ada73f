"""sources of the lexloom engine."""
