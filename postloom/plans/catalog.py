"""All queries of the library."""

from __future__ import annotations

from postloom.plans import (  # noqa: F401  they register their queries
    filter_queries,
    graph_queries,
    index_queries,
    ingest_queries,
    lasting_queries,
    maintenance_queries,
    privacy_queries,
    relational_queries,
    retrieval_queries,
    search_queries,
    secondary_queries,
    source_queries,
    stream_queries,
    text_queries,
    write_queries,
)
from postloom.plans.registry import QUERIES, SQL  # noqa: F401


def flagship(spark, sf_dir):
    return search_queries.hybrid_search(spark, sf_dir)
