"""Column builders for the language's scalar and aggregate semantics."""
