"""Postloom: mail-corpus retrieval and analytics as Spark jobs."""
