"""Operators of a large-scale training-data pipeline.

Self-contained: nothing outside this folder imports it, and it imports nothing from the rest of the library.
"""
