"""Release-diff analytics as Spark DataFrame operators."""
