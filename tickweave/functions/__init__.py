"""Column builders: every function here returns a Spark ``Column``."""
