"""Collects the registered queries of all groups."""

from __future__ import annotations

from . import catalog_alarms, catalog_events, catalog_guides, catalog_records, catalog_relational, catalog_rules, catalog_text, catalog_vectors

GROUPS = (catalog_vectors, catalog_relational, catalog_text, catalog_rules, catalog_events, catalog_records, catalog_alarms, catalog_guides)


def queries() -> dict:
    return {name: f for group in GROUPS for name, f in group.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: s for group in GROUPS for name, s in group.SQL.items()}
