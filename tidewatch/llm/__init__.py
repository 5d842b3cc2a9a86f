"""Operators for large-scale training-data preparation, and their queries.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when the folder is present.
"""
