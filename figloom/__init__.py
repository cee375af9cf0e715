"""figloom: a PySpark-native engine that builds, curates and scores figure corpora."""

__version__ = "0.1.0"
