"""plumbline: a PySpark-native analytics engine for text, catalogue and price data."""

__version__ = "0.1.0"
