"""Operators for preparing large training corpora.

Nothing outside this folder imports it; ``__spark_entry__`` registers its
queries only where the folder is present.
"""
