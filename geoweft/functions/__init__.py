"""Column functions: text, similarity, geometry and provenance links."""
