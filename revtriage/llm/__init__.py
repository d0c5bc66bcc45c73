"""Operators of a training-data pipeline (see README).

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded block of
``__spark_entry__.py`` imports it.
"""
