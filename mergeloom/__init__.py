"""mergeloom: a Spark-native table unification engine."""

__version__ = "0.1.0"
