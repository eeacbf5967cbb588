"""Operators of a large-scale training-data pipeline and their queries.

Nothing outside this folder (and the top-level ``corpus_pipeline.py``) imports it.
"""
