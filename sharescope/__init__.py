"""Document-estate analytics as composable Spark DataFrame operators."""
