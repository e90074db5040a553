"""arrowfen: vector collections and similarity search on PySpark."""

__version__ = "0.2.0"
