"""Relational operators: spatial joins, folds, blending, metrics."""
