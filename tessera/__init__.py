"""tessera: document retrieval, question answering and corpus processing over Spark DataFrames."""

__version__ = "0.1.0"
