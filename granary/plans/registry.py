"""All registered queries, with SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, build, sql: str | None = None) -> None:
    """Register a query; build takes (spark, sf_dir)."""
    if name in QUERIES:
        raise ValueError(f"the query {name} exists")
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _load() -> None:
    from granary.plans import decision, microqueries, surface  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
