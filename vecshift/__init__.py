"""vecshift: retrieval-preserving vector-collection processing on PySpark."""

__version__ = "0.1.0"
