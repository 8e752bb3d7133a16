"""Pure-Python parsers from source text to symbols, calls, extends and requires."""
