"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it, except the guarded import in
``__spark_entry__`` and the pipeline script at the repository top.
"""
