"""Operators of a training-data pipeline, each a function of DataFrames.

Nothing else in the library imports this subpackage; it imports only the
general helpers in ``lendlens.sources.tables``.
"""
