"""Relational, pattern, path and change operators over working tables."""
