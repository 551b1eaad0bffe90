"""quillon: a PySpark-native engine for open-source event intelligence."""

__version__ = "0.1.0"
