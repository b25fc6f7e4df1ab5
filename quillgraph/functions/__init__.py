"""Column expressions and the text parsers behind Python functions."""
