"""PySpark-native analytics: composable DataFrame operators for keyed measurements."""
