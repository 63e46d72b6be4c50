"""logsift: log parsing, search, statistics, template mining and anomaly
detection as Spark jobs."""

__version__ = "0.1.0"
