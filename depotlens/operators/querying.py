"""A declarative query surface: filter, order, page and field selection as plain values, composed into one plan.

Everything returned is a lazy DataFrame, so that filters and selected fields reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.operators.prefix_sum import running_sum

_OPERATORS = {
    "eq": lambda c, v: c.isNull() if v is None else c == v,
    "neq": lambda c, v: c.isNotNull() if v is None else (c != v) | c.isNull(),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)),
    "contains": lambda c, v: c.contains(v),
    "startsWith": lambda c, v: c.startswith(v),
    "endsWith": lambda c, v: c.endswith(v),
}


def predicate(spec: Mapping[str, Any] | None) -> Column:
    """A filter such as {"or": [{"state": {"eq": "F"}}, {"size": {"gte": 10, "lt": 20}}]}; None and {} keep all rows."""
    parts = []
    for name, value in (spec or {}).items():
        if name in ("and", "or"):
            inner = [predicate(x) for x in value]
            if inner:
                parts.append(reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), inner))
        elif name == "not":
            parts.append(~predicate(value))
        else:
            for op, operand in value.items():
                if op not in _OPERATORS:
                    raise ValueError(f"unknown operator {op}")
                parts.append(_OPERATORS[op](F.col(name), operand))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def optional_equal(column: str, value: Any) -> Column:
    """Filters only when a value is given."""
    return F.lit(True) if value is None else F.col(column) == value


def ordering(spec: Sequence[Mapping[str, str]]) -> list[Column]:
    """Sort keys such as [{"created_at": "DESC"}, {"id": "ASC"}]; nulls sort as the smallest value."""
    return [F.col(c).desc_nulls_last() if way.upper() == "DESC" else F.col(c).asc_nulls_first() for one in spec for c, way in one.items()]


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Only the asked fields, also nested ones by dotted name."""
    return df.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


def keyset_page(df: DataFrame, order: Sequence[Mapping[str, str]], first: int, after: Mapping[str, Any] | None = None) -> DataFrame:
    """The page after a cursor, found by comparing keys, with has_next on every row.

    ``order`` must be total and its keys not null; ``after`` holds the last row's keys.  One row more than asked tells whether
    there is more, and a top-n sort needs no full sort.
    """
    if after is not None:
        steps, equal = [], F.lit(True)
        for one in order:
            for c, way in one.items():
                beyond = F.col(c) < after[c] if way.upper() == "DESC" else F.col(c) > after[c]
                steps.append(equal & beyond)
                equal = equal & (F.col(c) == after[c])
        df = df.where(reduce(lambda a, b: a | b, steps))
    page = df.orderBy(*ordering(order)).limit(first + 1)
    # At most first + 1 rows are numbered.
    w = Window.orderBy(*ordering(order))
    numbered = page.withColumns({"page_row": F.row_number().over(w), "has_next": F.count("*").over(Window.partitionBy()) > first})
    return numbered.where(F.col("page_row") <= first)


def connection(df: DataFrame, order: Sequence[Mapping[str, str]], first: int, after: Mapping[str, Any] | None = None, where: Column | None = None) -> DataFrame:
    """A page with its envelope on every row: page_row, cursor (base64 of the sort keys as JSON), start_cursor, end_cursor, has_next,
    has_previous, total_count of the filtered rows and unfiltered_count of all.  An empty page has no row.

    Both counts are one aggregate that reads the filter's columns only; the page itself is a top-n."""
    keep = F.lit(True) if where is None else where
    counts = df.agg(F.count_if(keep).alias("total_count"), F.count("*").alias("unfiltered_count"))
    filtered = df.where(keep)
    page = keyset_page(filtered, order, first, after)
    keys = [c for one in order for c in one]
    page = page.withColumn("cursor", F.base64(F.to_json(F.struct(*keys)).cast("binary")))
    ends = Window.partitionBy()  # at most ``first`` rows
    page = page.withColumns({"start_cursor": F.min_by("cursor", "page_row").over(ends), "end_cursor": F.max_by("cursor", "page_row").over(ends), "has_previous": F.lit(after is not None)})
    return page.withColumn("__one", F.lit(1)).join(F.broadcast(counts.withColumn("__one", F.lit(1))), "__one").drop("__one")


def lookup_or_fail(rows: DataFrame, found: DataFrame, key: Sequence[str], value: str, what: str = "row") -> DataFrame:
    """Rows with ``value`` from ``found`` (one row a key); a key without a row is an error when the plan runs."""
    j = rows.join(found.select(*key, F.col(value).alias("__value"), F.lit(True).alias("__there")), list(key), "left")
    named = F.concat_ws(", ", *[F.col(k).cast("string") if dict(rows.dtypes)[k] != "binary" else F.hex(k) for k in key])
    there = F.when(F.col("__there"), True).otherwise(F.raise_error(F.concat(F.lit(f"no {what}: "), named)).cast("boolean"))
    return j.where(there).withColumn(value, F.col("__value")).drop("__value", "__there")


def offset_page(df: DataFrame, order: Sequence[Mapping[str, str]], page: int, size: int = 12) -> DataFrame:
    """Page number ``page`` from 1; smaller numbers are taken as 1."""
    return df.orderBy(*ordering(order)).offset((max(1, page) - 1) * size).limit(size)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group by a total order; the ranks are filtered early by Spark's window group limit."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_of(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by a total order."""
    cols = df.columns
    keyed = df.withColumns({f"__k{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(key)})
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(key))]).orderBy(*order)
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*cols)


def union_first(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union that keeps the first table's row for a key that both have."""
    return first.unionByName(second.join(first.select(*key), list(key), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Insert or update by key: columns in ``keep`` hold the old value where there is one, all others take the new row's."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    present = F.col(f"n.{key[0]}").isNotNull()
    pick = lambda c: (
        F.coalesce(f"o.{c}", f"n.{c}") if c in key or c in keep else F.when(present, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    )
    return o.join(n, on, "full").select(*[pick(c).alias(c) for c in old.columns])


def exactly_one(df: DataFrame) -> DataFrame:
    """At most one row; two or more are an error when the plan runs."""
    two = df.limit(2)
    counted = two.withColumn("__n", F.count("*").over(Window.partitionBy()))
    return counted.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row")).cast("boolean")).otherwise(True)).drop("__n")


def batches(df: DataFrame, bucket: Column, order: Sequence[Column | str], size: int) -> DataFrame:
    """Numbers all rows in fixed batches along a total order.

    ``bucket`` never decreases along the order and cuts the rows into parts that each fit a task, such as days for a table ordered
    by time; positions are running sums over the parts, so no task sees the whole table."""
    rows = df.withColumns({"__all": F.pmod(F.monotonically_increasing_id(), F.lit(1)), "__bucket": bucket, "__one": F.lit(1)})
    numbered = running_sum(rows, ["__all"], "__bucket", order, "__one", "__at")
    return numbered.withColumn("batch", F.floor(F.col("__at") / size).cast("bigint")).drop("__all", "__bucket", "__one", "__at")
