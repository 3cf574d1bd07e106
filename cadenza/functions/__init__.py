"""Column builders: expressions without a table of their own."""
