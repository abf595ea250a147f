"""Event-cohort analytics on PySpark."""
