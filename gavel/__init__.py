"""gavel: a Spark-native analytics engine for archives of debates, speeches, tags and vectors."""

__version__ = "0.1.0"
