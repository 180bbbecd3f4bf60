"""Arrays and maps in which order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def union_in_order(*arrays: Column) -> Column:
    """Distinct elements by first appearance."""
    return F.array_distinct(F.concat(*arrays))


def toggle(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def in_canonical_order(items: Column, order: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(items, x))


def flatten_map(m: Column) -> Column:
    """key, value, key, value, in the order of the keys."""
    entries = F.array_sort(F.map_entries(m))
    return F.flatten(F.transform(entries, lambda e: F.array(e["key"], e["value"])))


def merge_maps(left: Column, right: Column) -> Column:
    """Entries of both; the right one wins where a key is in both."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def lookup(table: dict[str, str], key: Column) -> Column:
    """The label of a key, or the key itself."""
    pairs = [F.lit(x) for entry in table.items() for x in entry]
    return F.coalesce(F.create_map(*pairs)[key], key)


def first_integer(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).cast("int")


def sorted_unique(x: Column) -> Column:
    """Distinct values in ascending order, nulls left out."""
    return F.array_sort(F.array_distinct(F.array_compact(x)))
