"""Training-data operators for large text corpora.

Each module holds one operator with a general DataFrame interface; the thin
queries in ``queries.py`` apply them to the driver tables. Nothing outside
this package imports it.
"""
