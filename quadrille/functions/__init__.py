"""Column-level functions on RDF terms and values."""
