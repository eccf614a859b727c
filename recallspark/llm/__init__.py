"""Operators for preparing training data.  Nothing outside this subpackage (and corpus_pipeline.py) imports it."""
