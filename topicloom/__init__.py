"""Spark-native topic modelling and vector analytics."""

__version__ = "0.1.0"
