"""Operators for text and event corpora. Nothing outside this subpackage imports it."""
