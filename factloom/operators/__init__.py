"""Relational operators over facts."""
