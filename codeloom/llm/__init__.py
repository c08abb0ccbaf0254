"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  Its queries are registered by
``codeloom.llm.queries``.
"""
