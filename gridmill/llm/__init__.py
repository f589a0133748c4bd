"""Training-data operators for large text corpora.

Each module holds one operator, usable on its own. ``queries`` has the thin
registered queries and ``oracles`` the SQL that checks them. Nothing outside
this package imports it.
"""
