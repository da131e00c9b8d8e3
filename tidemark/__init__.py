"""Tidemark: Spark DataFrame operators for irregular, timestamped event data."""
