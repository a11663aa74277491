"""millrace: a SQL analytics warehouse layer written against the PySpark DataFrame and SQL APIs."""
