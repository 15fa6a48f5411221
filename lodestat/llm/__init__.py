"""Operators for text corpora.  Nothing outside of this subpackage imports it."""
