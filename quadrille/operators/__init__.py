"""Graph operators beyond joins: paths, top-k, updates."""
