"""strandloom: Spark-first analytics over embedding corpora and expression tables."""
__version__ = "0.1.0"
