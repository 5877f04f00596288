"""Operators for preparing training data.

Nothing outside this package imports it. ``queries`` holds the thin queries and
their SQL; every other module is an operator with an interface of its own.
"""
