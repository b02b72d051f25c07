"""Training-data operators: packing, nearest neighbours, token rollups, extraction, language ID,
decontamination, near-duplicates, sharding, URL filters and secret scans.

Nothing outside this subpackage (but for the guarded import in ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it.
"""
