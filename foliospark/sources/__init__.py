"""Packages and their parts as rows."""
