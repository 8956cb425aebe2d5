"""Column functions: text forms, identity keys, artist names, export cells, similarity."""
