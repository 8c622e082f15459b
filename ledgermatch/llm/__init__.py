"""Operators for training-data pipelines: ten on text and conversations, next to the ledger library.

Nothing else in the library imports this subpackage.
"""
