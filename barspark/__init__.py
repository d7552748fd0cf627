"""Bar analytics on Spark: resampling, features, labels, signals, ledgers, performance."""

__version__ = "0.1.0"
