"""Operators for training-data pipelines.

Nothing outside this package imports it; the registry in ``__spark_entry__.py`` adds its queries
only when the package is present.
"""
