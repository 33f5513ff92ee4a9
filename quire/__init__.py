"""Quire: a PySpark-native engine for document ETL, retrieval, answer consistency and evaluation."""
