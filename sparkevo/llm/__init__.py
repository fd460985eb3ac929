"""Operators for preparing text corpora for model training.

Nothing else in the library imports this subpackage; ``queries`` and
``oracle_sql`` in :mod:`sparkevo.llm.queries` register its operators.
"""
