"""Relational operators on catalogs."""
