"""Streaming forms of row-local operators."""
