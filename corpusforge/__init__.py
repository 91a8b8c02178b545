"""Retrieval analytics and corpus building on PySpark."""
