"""Continuous ingestion; an extension."""
