"""Column functions: text rules and scoring."""
