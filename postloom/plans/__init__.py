"""Postloom plans."""
