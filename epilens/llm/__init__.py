"""Operators of a training-data pipeline: deduplication, quality filters,
licence scans, vector search, decontamination, URL rules, web archives,
tokenization and sharding. Nothing outside this folder (and
``corpus_pipeline.py``) imports it."""
