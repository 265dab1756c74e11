"""Granary: document-corpus preparation and evaluation-run analysis on PySpark."""
