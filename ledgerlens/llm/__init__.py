"""Operators of a training-data pipeline over a ``documents`` table.

Nothing outside this folder (but for the guarded registration in the entry
module) imports it. Registered queries are in ``queries.py``.
"""
