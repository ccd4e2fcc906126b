"""Operators of a training-data pipeline: packing, filtering, deduplication.

Nothing else in the library imports this subpackage.
"""
