"""Spark-first operators for longitudinal event data and training-data preparation."""
