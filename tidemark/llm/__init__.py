"""Operators of a training-data pipeline, on whole documents.

``documents`` always means a DataFrame with at least ``doc_id`` (integer) and
``text`` (string); other columns are ignored unless an operator names them, so
extra columns and clashing names do no harm.
"""
