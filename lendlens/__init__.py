"""lendlens: credit-risk profiling, association statistics and model
evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
