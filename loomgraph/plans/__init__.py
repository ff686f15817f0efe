"""The fluent query language over nodes, edges and paths, and its plans."""
