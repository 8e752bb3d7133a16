"""Training-data operators: quality, dedup, decontamination, tokenization, layout.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
