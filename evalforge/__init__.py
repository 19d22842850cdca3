"""evalforge: Spark-native dataset, evaluation and run-log analytics for code-model tuning."""

__version__ = "0.1.0"
