"""Sightline: a PySpark-native engine for building, auditing and evaluating inspection datasets."""
