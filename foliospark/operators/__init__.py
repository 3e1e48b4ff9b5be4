"""Relational operators over shredded packages."""
