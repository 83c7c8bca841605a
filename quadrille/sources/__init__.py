"""Graphs: triples in files or frames, and relational tables mapped to triples."""
