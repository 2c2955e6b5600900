"""Commerce, evaluation and query-log analytics as PySpark DataFrame programs."""
