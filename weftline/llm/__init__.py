"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; the queries and their
SQL live in :mod:`weftline.llm.queries`.
"""
