"""Record linkage and descriptive analytics as composable Spark DataFrame transformations."""
