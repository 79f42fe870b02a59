"""Spark-native analytics over ordered event streams of liquidity markets."""

__version__ = "0.1.0"
