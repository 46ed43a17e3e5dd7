"""Column expressions: parsing, encoding, geometry, scores."""
