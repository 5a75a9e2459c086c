"""Spark-native signal analytics: composable DataFrame operators and queries."""
