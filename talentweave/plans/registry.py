"""All queries of the engine by name, with the SQL that each is compared with."""

from __future__ import annotations

from talentweave.plans import people_queries, relational_queries, retrieval_queries, section_queries, text_queries

_PARTS = (retrieval_queries, text_queries, section_queries, people_queries, relational_queries)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
