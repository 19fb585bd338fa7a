"""Relational operators over the domain tables."""
