"""tracebed: code-evidence analytics as declarative Spark jobs."""

__version__ = "0.1.0"
