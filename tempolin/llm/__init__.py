"""Operators for preparing training data at scale.

Each module holds one operator; ``queries`` registers them.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
