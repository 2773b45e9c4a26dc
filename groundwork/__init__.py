"""groundwork: a Spark-native engine for evidence-grounded question answering over document collections."""
