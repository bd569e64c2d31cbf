"""Spark-native retrieval, de-duplication and governance engine for file and document collections."""
