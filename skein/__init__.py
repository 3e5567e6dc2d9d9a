"""skein: a Spark-native engine for retrieval, memory and corpus analytics."""

__version__ = "0.1.0"
