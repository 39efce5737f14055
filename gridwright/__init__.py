"""A Spark-native engine for choosing small, varied, spatially separated subsets of large record pools."""

__version__ = "0.1.0"
