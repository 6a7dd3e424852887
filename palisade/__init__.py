"""Palisade: security-finding analytics over code corpora, as Spark jobs."""

__version__ = "0.1.0"
