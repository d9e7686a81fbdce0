"""All registered queries of the core."""

from __future__ import annotations

from corpuskiln.plans import corpus_queries, mail_queries, note_queries, problems, retrieval_queries, star_queries

MODULES = [problems, retrieval_queries, corpus_queries, mail_queries, note_queries, star_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
