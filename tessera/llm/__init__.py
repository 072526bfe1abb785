"""Operators of a training-data pipeline: deduplication, filtering, packing, mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
