"""A Spark engine for compliance findings, and for preparing training data."""
