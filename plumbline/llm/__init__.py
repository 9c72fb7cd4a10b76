"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it, apart from the guarded hook in ``__spark_entry__.py``.
"""
