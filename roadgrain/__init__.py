"""Spark-native analytics engine for high-frequency vehicle telematics."""

__version__ = "0.1.0"
