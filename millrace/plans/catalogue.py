"""All queries of the core library and their SQL."""

from __future__ import annotations

from millrace.plans import content_queries, pipeline_queries, reference_queries

assert content_queries  # registers its queries beside those of reference_queries
QUERIES = {**reference_queries.QUERIES, **pipeline_queries.QUERIES}
ORACLE: dict[str, str] = {**reference_queries.ORACLE}
