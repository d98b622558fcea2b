"""All registered queries."""

from __future__ import annotations

from checks import browse_queries, change_queries, folder_queries, inventory_queries, parser_queries, report_queries, source_queries, varied_queries
from checks.common import Queries


def all_queries() -> Queries:
    found: Queries = {}
    for module in (
        source_queries, inventory_queries, folder_queries, browse_queries, parser_queries, report_queries, change_queries, varied_queries,
    ):
        found.update(module.QUERIES)
    return found
