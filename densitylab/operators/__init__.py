"""Relational and dense operators."""
