"""Streaming forms of the task log."""
