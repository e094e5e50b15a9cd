"""wardline — Spark-native clinical utilisation analytics."""

__version__ = "0.1.0"
