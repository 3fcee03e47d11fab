"""Composed plans: the staged analysis and the views over generic tables."""
