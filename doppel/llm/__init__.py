"""Training-data operators: near-duplicates, fingerprints, search, packing, mixing, extraction.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
