"""Catalogue price monitoring expressed as Spark DataFrame, SQL and Structured Streaming operators."""
