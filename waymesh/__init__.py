"""Road-network analytics as Spark DataFrame operators."""
