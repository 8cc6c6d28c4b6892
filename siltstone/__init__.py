"""A PySpark engine for searching, reading and ranking documents as tables."""
