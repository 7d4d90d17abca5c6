"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` and ``oracles.py``
here hold the registered queries and their SQL.
"""
