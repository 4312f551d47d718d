"""Operators on text and on very large tables for training-data pipelines.

Nothing outside this folder imports it; the rest of the library works without it.
"""
