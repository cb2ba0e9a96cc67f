"""Code-hosting activity analytics as Spark DataFrame operators."""
