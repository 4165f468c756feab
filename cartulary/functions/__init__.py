"""Column functions: text, paths, tags, JSON."""
