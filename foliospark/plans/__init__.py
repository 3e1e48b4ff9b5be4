"""Whole queries, as registered for the driver."""
