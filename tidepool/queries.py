"""All of the library's queries, but for those of the training-data operators."""

from __future__ import annotations

from tidepool import registry
from tidepool.operators import aliases, briefs, coverage, detectors, facts, graph, identity, items, linkers, merchants, nodes, noise, owner, people, policy, promises, purchases, recovery, retrieval, search, sessions, situations, spending, state, texts, threads, times, tools, upserts  # noqa: F401
from tidepool.sources import dav, formats  # noqa: F401
from tidepool.streaming import derived, ingest, passes, sessions as stream_sessions  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
