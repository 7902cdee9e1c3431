"""fairaudit: group-fairness audit and mitigation as Spark jobs."""

__version__ = "0.1.0"
