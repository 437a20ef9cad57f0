"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations


def collect() -> tuple[dict, dict]:
    from chargeframe.registry import features, io, modelling, relational, scheduling, streams

    queries, oracle = {}, {}
    for part in (io, relational, features, scheduling, modelling, streams):
        queries.update(part.QUERIES)
        oracle.update(part.ORACLE)
    return queries, oracle
