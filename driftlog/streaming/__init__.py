"""Streaming ingestion into a store."""
