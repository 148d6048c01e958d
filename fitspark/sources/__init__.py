"""Readers of documents, pages, job tables and study results."""
