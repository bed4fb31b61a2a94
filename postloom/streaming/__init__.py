"""Postloom streaming."""
