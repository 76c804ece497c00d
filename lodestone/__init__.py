"""lodestone: a Spark-native engine for repository and text analytics."""
