"""Registered queries: the operators and products on the given tables.

``all_queries()`` lists them. Each has a Spark function and, where SQL can say
the same, an independent statement that another engine runs for comparison.
"""

from __future__ import annotations

from recuento.catalog.base import Query


def all_queries() -> dict[str, Query]:
    from recuento.catalog import operators, products, scans

    merged: dict[str, Query] = {}
    for module in (scans, operators, products):
        for query in module.QUERIES:
            if query.name in merged:
                raise ValueError(f"query registered twice: {query.name}")
            merged[query.name] = query
    return merged
