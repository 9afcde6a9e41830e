"""Spatial entity-graph analytics on PySpark."""
