"""Evidence and document analytics as Spark DataFrame plans."""
