"""Spark-native retrieval, access-scoped analytics and corpus preparation."""
