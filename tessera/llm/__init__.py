"""Operators for preparing training text at scale: one module per operator, queries in ``queries``.

Nothing outside this folder imports it, so it can be removed without touching the rest.
"""
