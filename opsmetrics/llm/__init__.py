"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the package imports this subpackage; see ``queries.py`` for what it registers.
"""
