"""Whole answers built from the operators: presets, overview, model comparison, reports."""
