"""Survey analytics as PySpark jobs."""
