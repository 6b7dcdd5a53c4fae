"""Operators that prepare training data for language models, over whole DataFrames.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
