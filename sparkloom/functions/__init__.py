"""Column functions: paths and predicates, passages and text, vectors, hashes."""
