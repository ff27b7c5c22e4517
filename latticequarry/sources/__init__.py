"""sources of the pattern-mining engine."""
