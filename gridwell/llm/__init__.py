"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
