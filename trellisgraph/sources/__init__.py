"""Graph data: fragments, loaders and stored generations."""
