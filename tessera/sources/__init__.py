"""Readers of documents and files."""
