"""plans of the pattern-mining engine."""
