"""tessera: a Spark-native engine for captured JSON data."""
