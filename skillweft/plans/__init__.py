"""Domain views over relational tables, and the named queries with their SQL."""

from __future__ import annotations


def registry() -> tuple[dict, dict]:
    """All named queries and the SQL of those that SQL can express."""
    from skillweft.plans import flow_queries, graph_queries, quality_queries, record_queries, trend_queries, value_queries

    queries, sql = {}, {}
    for m in (trend_queries, quality_queries, graph_queries, record_queries, value_queries, flow_queries):
        queries |= m.QUERIES
        sql |= m.ORACLES
    return queries, sql
