"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator has a general interface in
its own module; the thin queries that the entry module registers are in :mod:`docloom.llm.registry`.
"""
