"""codestrata: code-graph analytics as ordinary Spark plans."""

__version__ = "0.1.0"
