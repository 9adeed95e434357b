"""terrace: a Spark-native engine for graph retrieval and dataset profiling."""
