"""Training-data operators: language, duplicates, tokens, quality and archives.

Self-contained: nothing outside this subpackage, ``tests/llm`` and
``corpus_pipeline.py`` depends on it.
"""
