"""Clustering of dynamic weighted graphs with PySpark."""
