"""Document-page analytics on PySpark: pages, verdicts, segments, files and jobs as DataFrames."""

__version__ = "0.1.0"
