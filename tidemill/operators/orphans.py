"""References to records that do not exist, per table and period.

Keys are encoded by a dictionary as integers in the order of their first use, dense within each block, so that keys
used together lie in the same range. References become one compressed bitmap per range of 32,768 keys and period, and
parents bitmaps of the keys born and deleted per period. A compressed bitmap is the sorted list of its 16-bit places (two
bytes a bit) and is turned into plain bits while its period is swept. Sweeping over the periods of one key range,
reference AND-NOT parent leaves the bits of keys that didn't exist during the whole period. These are decoded and, since
a parent may arrive or go within a period, checked against its exact times.

A key that a third of all rows refer to is one bit per period, so its weight ends at the map side. Bits are dealt out by
range as rows of a few bytes and bitmaps are made where they are swept, so no bitmap is shuffled.

Defined results: a null reference is no reference; a parent row without a time never counts as arrived; a reference
without a time is an orphan only if its parent never arrives; a parent with several rows exists from the earliest on
and is deleted from its earliest deletion on; repeated reference rows are reported once per row key; empty tables
are fine on either side (without parents every reference is an orphan).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize

RANGE = 32_768
#: Stands for rows without a time: after every period.
_NO_TIME = 2**31 - 1


def _period(column: str):
    return F.coalesce(F.unix_date(F.col(column).cast("date")), F.lit(_NO_TIME)).cast("int")


def dictionary(used: DataFrame, parents: DataFrame) -> DataFrame:
    """key, code, born, died of every key on either side; ``used`` has key and period. Codes run densely within a task's
    block of keys, and blocks are ranges of the period of first use.

    It is written out once, since codes made by position must not change when a task is repeated.
    """
    never = F.lit(None).cast("timestamp_ntz")
    keys = (
        used.select("key", F.col("period").alias("first"), never.alias("born"), never.alias("died"))
        .unionByName(parents.select("key", F.lit(None).cast("int").alias("first"), "born", "died"))
        .groupBy("key")
        .agg(F.min("first").alias("first"), F.min("born").alias("born"), F.min("died").alias("died"))
    )
    # keys of parents that nothing refers to come last
    placed = keys.withColumn("first", F.coalesce("first", F.lit(_NO_TIME))).repartitionByRange("first", "key").sortWithinPartitions("first", "key")
    return materialize(placed.select("key", F.monotonically_increasing_id().alias("code"), "born", "died"))


def _bits(coded: DataFrame, what: str) -> DataFrame:
    """key_range, period, what, spot of single bits; coded has one row per code and period."""
    place = F.col("code") + 1
    return coded.select(F.bitmap_bucket_number(place).alias("key_range"), "period", F.lit(what).alias("what"), F.bitmap_bit_position(place).cast("short").alias("spot"))


def compressed(bits: DataFrame) -> DataFrame:
    """Compressed bitmaps: the sorted places of each key range, period and kind, at most 32,768 of two bytes."""
    return bits.repartition("key_range").groupBy("key_range", "period", "what").agg(F.array_sort(F.collect_list("spot")).alias("spots"))


def _sweep(group: pd.DataFrame) -> pd.DataFrame:
    """Bits of references that no parent covers for the whole period; one key range, all its periods."""
    out_code, out_period = [], []
    alive = np.zeros(RANGE // 8, dtype=np.uint8)
    by = {w: dict(zip(g["period"], g["spots"], strict=True)) for w, g in group.groupby("what")}
    births, deaths, refs = (by.get(w, {}) for w in ("born", "died", "ref"))
    start = (int(group["key_range"].iloc[0]) - 1) * RANGE

    def as_bits(spots) -> np.ndarray:
        flags = np.zeros(RANGE, dtype=np.uint8)
        flags[np.asarray(spots, dtype=np.int64)] = 1
        return np.packbits(flags, bitorder="little")

    dead = np.zeros_like(alive)
    for period in sorted({*births, *deaths, *refs}):
        if period in deaths:
            dead = dead | as_bits(deaths[period])
        if period in refs:
            left = as_bits(refs[period]) & ~(alive & ~dead)
            found = np.flatnonzero(np.unpackbits(left, bitorder="little"))
            out_code.append(found + start)
            out_period.append(np.full(len(found), period, dtype=np.int32))
        if period in births:
            alive = alive | as_bits(births[period])
    if not out_code:
        return pd.DataFrame({"code": pd.Series(dtype="int64"), "period": pd.Series(dtype="int32")})
    return pd.DataFrame({"code": np.concatenate(out_code).astype("int64"), "period": np.concatenate(out_period)})


def orphans(refs: DataFrame, ref_column: str, at: str, parents: DataFrame, parent_key: str, born: str, died: str | None = None) -> DataFrame:
    """Rows of ``refs`` whose reference names no parent at that time, with all their columns and orphan_period (a date)."""
    rows = refs.where(F.col(ref_column).isNotNull()).select(
        F.struct(*(F.col(f"`{c}`") for c in refs.columns)).alias("__row"), F.col(ref_column).cast("string").alias("__key"), F.col(at).cast("timestamp_ntz").alias("__at"), _period(at).alias("__period")
    )
    used = rows.select(F.col("__key").alias("key"), F.col("__period").alias("period")).distinct()
    there = parents.where(F.col(parent_key).isNotNull()).select(
        F.col(parent_key).cast("string").alias("key"),
        F.col(born).cast("timestamp_ntz").alias("born"),
        (F.col(died).cast("timestamp_ntz") if died else F.lit(None).cast("timestamp_ntz")).alias("died"),
    )
    book = dictionary(used, there)
    coded = used.join(book.select("key", "code"), "key").select("code", "period")
    bits = _bits(coded, "ref")
    for event in ("born", "died"):
        bits = bits.unionByName(_bits(book.where(F.col(event).isNotNull()).select("code", _period(event).alias("period")), event))
    left = compressed(bits).groupBy("key_range").applyInPandas(_sweep, "code long, period int")
    suspects = left.join(book, "code").select(F.col("key").alias("__k"), F.col("period").alias("__p"), "born", "died")
    near = rows.join(suspects, (F.col("__key") == F.col("__k")) & (F.col("__period") == F.col("__p")))
    gone = F.col("born").isNull() | F.coalesce(F.col("born") > F.col("__at"), F.lit(False)) | F.coalesce(F.col("died") <= F.col("__at"), F.lit(False))
    return near.where(gone).select("__row.*", F.when(F.col("__period") != _NO_TIME, F.date_from_unix_date("__period")).alias("orphan_period"))


def report(found: DataFrame, table_name: str, ref_column: str) -> DataFrame:
    """Orphan rows and distinct keys per period."""
    return found.groupBy(F.col("orphan_period").alias("period")).agg(F.count(F.lit(1)).alias("orphan_rows"), F.countDistinct(ref_column).alias("orphan_keys")).select(
        F.lit(table_name).alias("table_name"), F.lit(ref_column).alias("ref_column"), "period", "orphan_rows", "orphan_keys"
    )
