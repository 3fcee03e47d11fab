"""Spark-native analytics over tables of oriented 3-D particles."""

__version__ = "0.1.0"
