"""Spark-first analytics for gridded time series, vertical profiles and training text."""
