"""Operators of a training-data pipeline; ``queries`` registers one query per operator.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
