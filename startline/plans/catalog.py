"""Every query of the engine by name, with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from startline.plans import crawl_queries, extract_queries, live_queries, people_queries, report_queries, store_queries, whole_queries

MODULES = (report_queries, crawl_queries, extract_queries, whole_queries, store_queries, live_queries, people_queries)


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
