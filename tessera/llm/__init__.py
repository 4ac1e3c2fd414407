"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; :mod:`tessera.llm.queries` wraps them into registered queries.
"""
