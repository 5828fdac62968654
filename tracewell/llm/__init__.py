"""Operators for preparing text corpora at scale; see the README for the methods."""
