"""Palimpsest: long-term memory, code-graph and training-corpus analytics on PySpark."""
