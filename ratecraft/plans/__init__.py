"""Composed plans: feature matrix, serving, skew-aware joins, query registry."""
