"""leafmill: a PySpark-native analytics engine for document pages, text lines and extracted facts."""

__version__ = "0.1.0"
