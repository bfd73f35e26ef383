"""Training-data operators: cleaning, deduplication, packing, archives, sharding,
personal data, decontamination and toxicity.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
