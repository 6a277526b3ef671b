"""tessaria: a Spark-first analytics engine for threat-intelligence records."""

__version__ = "0.1.0"
