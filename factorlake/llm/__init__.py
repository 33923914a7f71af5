"""Operators for preparing language-model training data, each a Spark job over whole tables.

Nothing outside this package imports it; `queries.py` lists what the driver runs.
"""
