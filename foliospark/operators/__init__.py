"""Corpus-level operators."""
