"""Sessions, dialect, cached tables and their statistics."""
