"""Functions that the SQL dialect has and Spark lacks, or gives other results for."""
