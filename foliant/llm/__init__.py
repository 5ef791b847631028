"""Operators for preparing training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
