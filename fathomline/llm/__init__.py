"""Operators for training-data pipelines over text corpora.

Nothing outside this package imports it.  Text rules shared by the operators:
a null text counts as empty, a *word* is a maximal run of characters other than
``\\x20`` and ``\\x09-\\x0D``, and lower-casing touches A-Z only.
"""
