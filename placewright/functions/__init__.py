"""Column functions: geometry, layer names, checks."""
