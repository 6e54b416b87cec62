"""ticktide: market-bar analytics as composable Spark DataFrame transformations."""
