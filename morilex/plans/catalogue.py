"""All queries of the core engine by name, with their SQL."""

from __future__ import annotations

from . import acquire, aggregates, corpus, entries, evaluate, filters, keeping, lexicon, lookups, matches, models, nouns, order, registering, registry, scans, streams  # noqa: F401  (they register)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
