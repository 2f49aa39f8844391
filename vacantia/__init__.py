"""vacantia: a PySpark-native engine for job-listing data."""

__version__ = "0.1.0"
