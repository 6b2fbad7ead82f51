"""Stores, ingest and search: what puts operators together."""
