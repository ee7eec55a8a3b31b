"""Detection-data analytics as Spark DataFrame operators."""
