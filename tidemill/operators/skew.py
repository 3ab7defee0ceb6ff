"""Per-key results when a few keys hold most rows.

Two-stage salted aggregation: rows of heavy keys get a salt, partial results are made per key and salt, and the
partials are merged by the key alone. Distinct values are salted by their own hash, so each lies in one salt and the
partial distinct counts add up exactly.

Which keys are heavy comes from one pass with a frequent-items sketch: a task keeps at most 1/share keys, the sketches are
merged, and every key with that share is among those left. So nothing is shuffled by key to find out, the list joined
back is bounded by the parameter whatever the data, and a key too many in it is salted needlessly, no more. The salt is
a hash of columns of the row, not rand(): a recomputed task gives the same rows to the same reducers.

Defined results: null is a key of its own; an empty table gives no rows; ties at the threshold count as heavy;
repeated rows count as often as they are stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize


def heavy_keys(frame: DataFrame, key: str, share: float) -> DataFrame:
    """All keys with at least this share of all rows, and perhaps some with less: at most 1/share rows, as __heavy."""
    found = frame.select(F.col(key).alias("k")).stat.freqItems(["k"], share)
    return found.select(F.explode("k_freqItems").alias("__heavy")).distinct()


def salted_aggregate(
    frame: DataFrame,
    key: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    distinct: Mapping[str, str] | None = None,
    spread: Sequence[str] = (),
    share: float = 0.01,
    salts: int = 64,
) -> DataFrame:
    """Rows, sums, maxima and exact distinct counts per key: key, n, then the given names.

    ``spread`` names the columns whose hash salts the rows of heavy keys (all columns if none are named); for a distinct
    count its own column is used.
    """
    sums, maxima, distinct = dict(sums or {}), dict(maxima or {}), dict(distinct or {})
    flagged = frame.join(F.broadcast(heavy_keys(frame, key, share)), F.col(key).eqNullSafe(F.col("__heavy")), "left")
    # null is never matched apart from a null heavy key: coalesce tells a null key that is heavy from one that isn't
    is_heavy = F.col("__heavy").isNotNull() | F.col(key).isNull()

    def salt(columns: Sequence[str]) -> Column:
        by = [F.col(c) for c in columns or frame.columns]
        return F.when(is_heavy, F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(F.lit(0)).cast("int")

    staged = (
        flagged.withColumn("__salt", salt(spread))
        .groupBy(key, "__salt")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(F.sum(c).alias(name) for name, c in sums.items()),
            *(F.max(c).alias(name) for name, c in maxima.items()),
        )
    )
    out = staged.groupBy(key).agg(
        F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in sums), *(F.max(name).alias(name) for name in maxima)
    )
    for name, column in distinct.items():
        part = (
            flagged.withColumn("__salt", salt([column]))
            .groupBy(key, "__salt", column)
            .agg(F.lit(1).alias("one"))
            .groupBy(key, "__salt")
            .agg(F.count(column).alias("d"))
            .groupBy(F.col(key).alias("__k"))
            .agg(F.sum("d").alias(name))
        )
        out = out.join(part, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    return out


def heavy_report(frame: DataFrame, key: str, share: float, spread: Sequence[str] = (), salts: int = 64) -> DataFrame:
    """Non-null keys with at least ``share`` of all rows: key, n; counted by the salted aggregation."""
    # one row per key, written out so that the total is taken from it without another pass
    counted = materialize(salted_aggregate(frame, key, spread=spread, share=share, salts=salts))
    total = counted.agg(F.sum("n").alias("total")).scalar()
    return counted.where(F.col(key).isNotNull() & (F.col("n") >= F.lit(Decimal(str(share))) * total))
