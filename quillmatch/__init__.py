"""Spark-native similarity engine for source code and text."""
