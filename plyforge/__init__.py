"""Plyforge: a Spark-native engine for building, checking and using datasets of game positions."""

__version__ = "0.1.0"
