"""Near-duplicate search over embedding vectors, expressed as Spark DataFrame operators."""
