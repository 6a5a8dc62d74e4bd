"""Spark jobs that find security-relevant commits without hand labels."""
