"""Spark-first building, profiling and evaluation of metadata extracted from document collections."""
