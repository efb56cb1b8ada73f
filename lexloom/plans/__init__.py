"""plans of the lexloom engine."""
