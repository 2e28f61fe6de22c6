"""Operators for large training-data pipelines.

Nothing else in the package imports this folder.  Each module holds one
operator with a general interface; ``registry`` holds the thin queries that
apply them to whole tables.
"""
