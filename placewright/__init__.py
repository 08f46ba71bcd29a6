"""Explainable placement analytics on PySpark."""
