"""Comment moderation analytics as composable Spark DataFrame transformations."""
