"""Relational operators: exact and similar duplicates, views, policies, components."""
