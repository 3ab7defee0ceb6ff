"""Differences between two copies of a dataset.

Both copies are brought to common column types. One bag difference gives EXCEPT ALL in both directions: the union of
the copies is counted per distinct row and side, so each row is shuffled once and repeats are combined before they
are. What is left on either side, its residue, is then full-joined by key.

Defined results:

* numbers compare by value whatever their width and scale, two nulls are equal, null keys are a key of their own;
* repeats of one row are no difference (``repeats=True`` reports counts that differ as field ``row_count``);
* a key whose residue has several different rows on a side is compared by the smallest row of either side (if both
  have any) and also reported as field ``distinct_rows``, also where the other side has none; no row is lost silently and no group of rows is gathered in one task;
* columns that only one copy has are not compared; see ``columns_apart``;
* two empty tables give no rows; an empty copy makes every key ``only_in_base``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def common_type(a: T.DataType, b: T.DataType) -> str:
    """The type in which values of both columns compare by value."""
    if isinstance(a, (T.MapType, T.VariantType)) or isinstance(b, (T.MapType, T.VariantType)):
        return "json"
    if a == b and not isinstance(a, T.DecimalType):
        return a.simpleString()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return "double"
        whole, scale = 0, 0
        for t in (a, b):
            p, s = (t.precision, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[t.simpleString()], 0)
            whole, scale = max(whole, p - s), max(scale, s)
        return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else "string"
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return "timestamp_ntz"
    return "string"


def _as(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if kind == "json" else column.cast(kind)


def columns_apart(base: DataFrame, copy: DataFrame) -> dict[str, list[str]]:
    """Names that only one of the copies has."""
    return {
        "only_in_base": [c for c in base.columns if c not in copy.columns],
        "only_in_copy": [c for c in copy.columns if c not in base.columns],
    }


def bag_counts(base: DataFrame, copy: DataFrame) -> tuple[DataFrame, list[str]]:
    """Each distinct normalised row with its number in base and copy; positional names c0, c1, ... avoid clashes."""
    shared = [c for c in base.columns if c in copy.columns]
    kinds = {c: common_type(base.schema[c].dataType, copy.schema[c].dataType) for c in shared}
    names = [f"c{i}" for i in range(len(shared))]

    def side(frame: DataFrame, in_base: int) -> DataFrame:
        return frame.select(
            *(_as(c, kinds[c]).alias(n) for c, n in zip(shared, names, strict=True)),
            F.lit(in_base).cast("long").alias("n_base"),
            F.lit(1 - in_base).cast("long").alias("n_copy"),
        )

    counted = (
        side(base, 1).unionAll(side(copy, 0)).groupBy(*names).agg(F.sum("n_base").alias("n_base"), F.sum("n_copy").alias("n_copy"))
    )
    return counted, shared


def except_all(base: DataFrame, copy: DataFrame) -> DataFrame:
    """EXCEPT ALL in both directions: rows of the common columns with ``side`` and how many more that side has."""
    counted, shared = bag_counts(base, copy)
    more = F.col("n_base") - F.col("n_copy")
    return counted.where(more != 0).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(shared)),
        F.when(more > 0, "base").otherwise("copy").alias("__side"),
        F.abs(more).alias("__times"),
    )


def differences(base: DataFrame, copy: DataFrame, key: str | Sequence[str], repeats: bool = False) -> DataFrame:
    """One row per one-sided key and per differing field: the key columns, field_name, base_value, copy_value (texts)."""
    keys = [key] if isinstance(key, str) else list(key)
    counted, shared = bag_counts(base, copy)
    at = {c: f"c{i}" for i, c in enumerate(shared)}
    fields = [c for c in shared if c not in keys]
    ks = [at[k] for k in keys]
    residue = counted.where((F.col("n_base") != F.col("n_copy")) if repeats else (F.least("n_base", "n_copy") == 0))

    def side(name: str) -> DataFrame:
        other = "n_copy" if name == "base" else "n_base"
        mine = f"n_{name}"
        return (
            residue.where(F.col(mine) > F.col(other))
            .groupBy(*(F.col(k).alias(f"{name}_{k}") for k in ks))
            .agg(
                F.count(F.lit(1)).alias(f"rows_{name}"),
                F.max(F.least(mine, other)).alias(f"again_{name}"),
                F.min(F.struct(*(F.col(at[f]) for f in fields), F.lit(0).alias("__pad"))).alias(f"row_{name}"),
            )
        )

    on = None
    for k in ks:
        same = F.col(f"base_{k}").eqNullSafe(F.col(f"copy_{k}"))
        on = same if on is None else on & same
    both = side("base").join(side("copy"), on, "full")

    def entry(name: str, b: Column, c: Column, when: Column) -> Column:
        return F.struct(F.lit(name).alias("field_name"), b.cast("string").alias("base_value"), c.cast("string").alias("copy_value"), when.alias("is_case"))

    left, right = F.col("rows_base").isNotNull(), F.col("rows_copy").isNotNull()
    again = F.greatest(F.coalesce("again_base", F.lit(0)), F.coalesce("again_copy", F.lit(0))) > 0
    none = F.lit(None)
    entries = [
        entry("only_in_base", none, none, left & ~right & ~again),
        entry("only_in_copy", none, none, right & ~left & ~again),
        entry("row_count", F.col("rows_base"), F.col("rows_copy"), again),
        entry("distinct_rows", F.col("rows_base"), F.col("rows_copy"), F.coalesce(F.greatest("rows_base", "rows_copy") > 1, F.lit(False))),
    ]
    for f in fields:
        b, c = F.col("row_base")[at[f]], F.col("row_copy")[at[f]]
        entries.append(entry(f, b, c, left & right & ~b.eqNullSafe(c)))
    return (
        both.select(
            *(F.when(left, F.col(f"base_{k}")).otherwise(F.col(f"copy_{k}")).alias(name) for k, name in zip(ks, keys, strict=True)),
            F.explode(F.filter(F.array(*entries), lambda e: e["is_case"])).alias("__e"),
        ).select(*(f"`{k}`" for k in keys), "__e.field_name", "__e.base_value", "__e.copy_value")
    )
