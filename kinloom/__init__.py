"""kinloom: a Spark-native record-linkage and corpus analytics engine."""

__version__ = "0.1.0"
