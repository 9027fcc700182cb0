"""Operators of a training-data pipeline over tables of texts, vectors and urls.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame, names the
columns it needs, ignores all others, and returns a DataFrame; ``queries`` applies each of
them to its table.
"""
