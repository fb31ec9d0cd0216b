"""A Spark-native engine for building, resolving, searching and evaluating knowledge graphs."""
