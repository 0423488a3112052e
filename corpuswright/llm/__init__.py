"""Operators of a training-data pipeline: extraction, filtering, deduplication, scoring and encoding.

Every operator is a function from DataFrame to DataFrame. Each picks the
columns it needs by name, so extra columns never clash, and says in its
docstring what nulls, empty texts, ties and repeated rows give.
"""
