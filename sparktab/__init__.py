"""sparktab: Spark-native tabular profiling, cleaning, encoding, metrics,
drift and model operators.  Every operator takes and returns a lazy
DataFrame; nothing is collected except small fitted statistics."""

__version__ = "0.1.0"
