"""Whole queries and sessions, and the tables they keep."""
