"""Operators for large training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where the subpackage is present.
"""
