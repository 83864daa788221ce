"""Composed plans and the query catalog."""
