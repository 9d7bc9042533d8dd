"""Training-data operators: ten components for text corpora.

Nothing outside this subpackage imports it.
"""
