"""streaming of the lexloom engine."""
