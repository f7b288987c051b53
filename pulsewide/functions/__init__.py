"""Column-level functions built from Spark SQL built-ins."""
