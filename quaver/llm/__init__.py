"""Corpus operators for large text collections.

Nothing outside this subpackage imports it; the package works without it.
"""
