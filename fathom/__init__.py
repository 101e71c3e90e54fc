"""Fathom: a PySpark-native engine for gridded-survey analytics."""
