"""Composed answers over the stored tables."""
