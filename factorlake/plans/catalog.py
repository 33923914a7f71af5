"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from functools import lru_cache

from factorlake.plans import combo_queries, factor_queries, ledger_queries, registry_queries, study_queries

MODULES = [factor_queries, combo_queries, study_queries, ledger_queries, registry_queries]


@lru_cache(maxsize=1)
def _all() -> tuple[dict, dict]:
    q: dict = {}
    o: dict = {}
    for m in MODULES:
        queries, sql = m.queries_and_sql()
        if q.keys() & queries.keys():
            raise ValueError(f"registered twice: {q.keys() & queries.keys()}")
        q |= queries
        o |= sql
    return q, o


def queries() -> dict:
    return dict(_all()[0])


def oracle_sql() -> dict:
    return dict(_all()[1])
