"""Quality facts about a corpus of source or text documents, on Spark."""

__version__ = "0.1.0"
