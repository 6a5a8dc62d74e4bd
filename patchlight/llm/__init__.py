"""Corpus preparation for language-model training, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
