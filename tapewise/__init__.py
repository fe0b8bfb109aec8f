"""Event research over bar data and over strategy registries, as Spark DataFrame operators."""
