"""Tessera: a PySpark-native engine for triaging, ranking and deduplicating documents."""
