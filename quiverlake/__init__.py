"""A PySpark engine for vector search and its analytics."""
