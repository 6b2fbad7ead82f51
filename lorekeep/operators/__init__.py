"""Relational operators over chunks, sources and vectors."""
