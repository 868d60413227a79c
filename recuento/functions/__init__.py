"""Column expressions: built-in Spark expressions only, no Python in the tasks."""
