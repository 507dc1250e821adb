"""Registered queries: one module per area, each with QUERIES and SQL."""

MODULES = ("dealt", "text", "search", "corpus", "graph", "relations", "candidates", "records")
