"""operators of the pattern-mining engine."""
