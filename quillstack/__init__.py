"""Spark-first analytics for scholarly libraries: catalogue, text and vector search, data quality."""
