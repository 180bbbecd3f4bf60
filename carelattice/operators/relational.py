"""Filtered listings, pages, ownership and default joins, fan-out and assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE, LARGEST_PAGE = 20, 100
#: Values of an IN list that are written into the plan; longer lists are joined.
INLINE_VALUES = 200


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Equality filters for the arguments that aren't None; a list or tuple means any of its values."""
    for name, value in equal.items():
        if value is not None:
            df = in_values(df, name, list(value)) if isinstance(value, (list, tuple, set)) else df.filter(F.col(name) == F.lit(value))
    return df


def in_values(df: DataFrame, name: str, values: list, keep: bool = True) -> DataFrame:
    """Rows whose column is (or with keep=False isn't) one of ``values``; nulls are kept by the latter only."""
    values = [v for v in values if v is not None]
    if len(values) <= INLINE_VALUES:
        found = F.coalesce(F.col(name).isin(values), F.lit(False))
        return df.filter(found if keep else ~found)
    side = df.sparkSession.createDataFrame([(v,) for v in values], df.select(name).schema)
    return df.join(side.distinct(), name, "left_semi" if keep else "left_anti")


def between_given(df: DataFrame, name: str, start=None, end=None) -> DataFrame:
    """Both ends included; an end that is None is open."""
    limits = ([F.col(name) >= F.lit(start)] if start is not None else []) + ([F.col(name) <= F.lit(end)] if end is not None else [])
    return reduce(DataFrame.filter, limits, df)


def on_days(df: DataFrame, name: str, first=None, last=None) -> DataFrame:
    """From the start of day ``first`` to the end of day ``last``, as a half-open interval that scans can prune by."""
    if first is not None and last is not None and first > last:
        raise ValueError("the first day is after the last")
    if first is not None:
        df = df.filter(F.col(name) >= F.to_timestamp_ntz(F.lit(str(first))))
    if last is not None:
        df = df.filter(F.col(name) < F.to_timestamp_ntz(F.date_add(F.to_date(F.lit(str(last))), 1).cast("string")))
    return df


def any_column_contains(df: DataFrame, keyword: str | None, *columns: str) -> DataFrame:
    """Literal keyword in any of the columns, whatever the case and accents; no filter for an empty keyword."""
    if not keyword:
        return df
    found = [F.contains(F.collate(F.col(c), "UNICODE_CI_AI"), F.collate(F.lit(keyword), "UNICODE_CI_AI")) for c in columns]
    return df.filter(reduce(Column.__or__, [F.coalesce(f, F.lit(False)) for f in found]))


def joined_columns_contain(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Trimmed, lower-cased term in the columns joined by blanks; it may span two of them."""
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    return df.filter(F.contains(text, F.lit(term.strip().lower())))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page in a total order (put a unique key last), as a top-k with offset."""
    if number < 1 or not 1 <= size <= LARGEST_PAGE:
        raise ValueError(f"pages count from 1 and hold 1 to {LARGEST_PAGE} rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The page with the count of all rows beside each row: a partial count and a top-k, no global window.

    A page past the end has no rows and so no total; ``listing`` has it then too.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, number, size).join(F.broadcast(total))  # one row by one count


def listing(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One row for a page: its rows in their order as ``items`` (none past the end), ``total``, ``offset`` and ``limit``.

    At most a page of rows is gathered.
    """
    found = page(df, order, number, size).withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # a window over one page
    items = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*df.columns).alias("item")))), lambda x: x["item"]).alias("items"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return items.join(F.broadcast(total)).select("items", "total", F.lit((number - 1) * size).alias("offset"), F.lit(size).alias("limit"))


def first_due(df: DataFrame, due: Column, order: list[Column], most: int = 100) -> DataFrame:
    """The first ``most`` rows that are due. The condition comes before the limit, so rows that aren't can't fill the batch."""
    return df.filter(due).orderBy(*order).limit(most)


def owned_by(df: DataFrame, parents: DataFrame, key: str, owner: Column) -> DataFrame:
    """Rows whose parent meets ``owner``."""
    return df.join(parents.filter(owner).select(key).distinct(), key, "left_semi")


def with_default(df: DataFrame, side: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join to a side with one row for each key; the named columns get their default where it has none."""
    joined = df.join(side.select(key, *defaults), key, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def with_count(df: DataFrame, children: DataFrame, key: str, name: str, counted: Column | None = None) -> DataFrame:
    """Each row with the number of its children (those that are ``counted``), 0 if none."""
    counts = (children if counted is None else children.filter(counted)).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def fan_out(df: DataFrame, targets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """One row for each target of a row, and the rows without any."""
    return df.join(targets, key), df.join(targets.select(key), key, "left_anti")


def missing_ids(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Distinct wanted keys that aren't found; null keys are left out."""
    return wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(found.select(key), key, "left_anti")


def ordered_list(order: list[str], value: Column) -> Column:
    """Aggregate: values in the order of the named columns, which must tell rows apart."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.transform(rows, lambda r: r["_value"])


def assemble(parents: DataFrame, key: str, **children: tuple[DataFrame, list[str], Column]) -> DataFrame:
    """Parents with one ordered list for each child table; each table is grouped alone, so lists don't multiply."""
    for name, (table, order, value) in children.items():
        lists = table.groupBy(key).agg(ordered_list(order, value).alias(name))
        parents = parents.join(lists, key, "left")
    return parents


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def priority(level: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), level).cast("int")


def higher(a: Column, b: Column, order: list[str]) -> Column:
    """The later of two levels in ``order``; the one that is there if the other is null."""
    return F.element_at(F.array(*map(F.lit, order)), F.nullif(F.greatest(priority(a, order), priority(b, order)), F.lit(0)))


def keeps_one(df: DataFrame, condition: Column) -> DataFrame:
    """One row: does at least one row meet the condition?"""
    return df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("holds"))


def reject_missing(df: DataFrame, allowed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``allowed``, and those for which it isn't."""
    side = allowed.select(*key).distinct()
    return df.join(side, key, "left_semi"), df.join(side, key, "left_anti")
