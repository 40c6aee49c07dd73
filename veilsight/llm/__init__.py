"""Training-data operators.

Nothing outside this subpackage imports it.  ``queries.py`` holds the
registered queries and their SQL.
"""
