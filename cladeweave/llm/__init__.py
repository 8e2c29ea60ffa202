"""Operators for large text corpora: deduplication, filtering, formatting and tokenisation.

Nothing outside this subpackage imports it.  Registered queries are in ``queries``.
"""
