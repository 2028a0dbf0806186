"""Geo-temporal event-risk analytics expressed as Spark DataFrame plans."""
