"""Operators for large training-text corpora.

Nothing else in the package imports this folder; ``__spark_entry__`` registers
its queries only when the folder is present.
"""
