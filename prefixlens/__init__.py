"""prefixlens: a PySpark-native analytics engine for captured chat requests."""

__version__ = "0.1.0"
