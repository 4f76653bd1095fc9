"""Index build, search and structural analyses."""
