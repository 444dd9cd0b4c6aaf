"""Column expressions: text rules, geometry, JSON plans and URLs."""
