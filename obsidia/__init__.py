"""obsidia: a Spark-native observability analytics engine."""
