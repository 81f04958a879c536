"""quillon: a PySpark-native analytics engine for document-and-practice corpora."""

__version__ = "0.1.0"
