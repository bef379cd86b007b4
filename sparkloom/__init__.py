"""A PySpark engine for indexing and searching repositories and document collections."""
