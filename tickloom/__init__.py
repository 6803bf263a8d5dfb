"""Tick analytics on Spark: load, query and export order-book events."""
