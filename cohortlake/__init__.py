"""cohortlake: a Spark-first engine for de-identifying and querying imaging cohorts."""

__version__ = "0.1.0"
