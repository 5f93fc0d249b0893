"""Whole studies, from inputs to result tables."""
