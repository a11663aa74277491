"""Relational operators beyond single DataFrame calls, and one query for each operator of the library."""
