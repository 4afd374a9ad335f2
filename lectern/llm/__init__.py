"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; ``queries`` holds the thin registered
queries. Rows are told apart by a number that every job finds the same (``common.numbered``). Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` depends on it.
"""
