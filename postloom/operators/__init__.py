"""Postloom operators."""
