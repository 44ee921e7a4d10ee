"""All queries of the core, by name."""

from __future__ import annotations

from .plans import extra, fields, oracles, reference, renames, services, state, timestamps
from .plans.runner import oracle, query

FLAGSHIP = extra.quality_routes


def queries() -> dict:
    out = {name: query(build, name in reference.HEAVY) for name, build in reference.BUILD.items()}
    out.update(fields.QUERIES)
    out.update(extra.QUERIES)
    out.update(state.QUERIES)
    out.update(renames.QUERIES)
    out.update(services.QUERIES)
    out.update(timestamps.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: oracle(build) for name, build in reference.BUILD.items()}
    out.update(oracles.SQL)
    out.update(extra.oracles())
    out.update(state.SQL)
    out.update(renames.SQL)
    out.update(services.sql())
    out.update(timestamps.SQL)
    return out
