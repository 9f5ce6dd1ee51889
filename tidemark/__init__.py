"""Versioned key-value tables on Apache Spark."""
