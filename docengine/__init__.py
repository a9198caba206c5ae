"""A PySpark-native document retrieval and corpus analytics engine."""
