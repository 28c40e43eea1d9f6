"""A PySpark engine for turning pixel tables into terminal text."""
