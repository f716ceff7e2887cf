"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; it can be deleted together with
``corpus_pipeline.py`` and ``tests/llm`` and the rest of the engine still works.
"""
