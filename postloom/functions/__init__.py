"""Postloom functions."""
