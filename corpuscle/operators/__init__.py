"""Corpus operators."""
