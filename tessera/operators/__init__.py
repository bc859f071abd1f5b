"""Relational operators over documents, facts, differences and tasks."""
