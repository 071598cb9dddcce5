"""Log, metric and alert analytics for a fleet of hosts, expressed as Spark DataFrames."""

__version__ = "0.1.0"
