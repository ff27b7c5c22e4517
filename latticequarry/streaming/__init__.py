"""streaming of the pattern-mining engine."""
