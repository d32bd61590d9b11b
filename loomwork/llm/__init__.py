"""Corpus preparation for language models. Nothing outside this package imports it."""
