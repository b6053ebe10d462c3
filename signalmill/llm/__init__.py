"""Operators that prepare large text corpora for language-model training.

Nothing else in the library imports this subpackage. Each module holds one operator with its own
general interface; ``queries.py`` holds the thin registered queries.
"""
