"""Postloom sources."""
