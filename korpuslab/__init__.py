"""korpuslab: a PySpark-native engine for evaluating speech-to-text corpora."""

__version__ = "0.1.0"
