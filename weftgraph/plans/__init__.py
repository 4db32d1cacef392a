"""Whole programs: building a graph from sources, and free read-only queries over it."""
