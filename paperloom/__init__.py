"""Document-intelligence analytics on Spark: declarative DataFrame operators over document corpora."""

__version__ = "0.1.0"
