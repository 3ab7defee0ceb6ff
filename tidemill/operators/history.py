"""Full history of changing attributes as a bitemporal ledger.

Every update holds from its valid time on and was recorded at its recorded time. The ledger has one row per interval
of valid time as it was believed during an interval of recorded time. A late update splits the interval that it falls
into: the earlier row is superseded (its recorded_to is set) and never overwritten.

The sweep over the updates of an entity in valid order needs, for each update, its neighbour on either side among
those recorded before it: the nearest smaller recorded time. Updates in order get both from running minima and
maxima. Only runs of late updates between two updates in order go through a stack, in Python, run by run.

Running values are taken per entity and month, then carried over a summary of one row per entity and month, so an
entity with a third of all rows is spread over as many tasks as it has months.

Defined results: exact repeats count once; of updates with the same valid time the one recorded last (then the
greatest by value) is believed; null attributes are values of their own; rows without valid time are left out, since
they hold at no time; a null key is an entity of its own; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import materialize
from tidemill.sources.versioned import VersionedTable


def running(frame: DataFrame, keys: Sequence[str], order: str, block: str, specs: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """Running extremes over the other rows of an entity: name -> ('max' or 'min', 'before' or 'after', value).

    The current row doesn't count. ``order`` names one orderable column (a struct), unique within an entity. Two
    levels: windows within (keys, block), and a window over one row per (keys, block).
    """
    of = {"max": F.max, "min": F.min}
    parts = [*keys, block]
    up = Window.partitionBy(*parts).orderBy(F.col(order).asc()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*parts).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks_up = Window.partitionBy(*keys).orderBy(F.col(block).asc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks_down = Window.partitionBy(*keys).orderBy(F.col(block).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = frame.groupBy(*parts).agg(*(of[f](v).alias(f"__s_{name}") for name, (f, _, v) in specs.items()))
    carried = summary.select(
        *(F.col(c).alias(f"__c_{c}") for c in parts),
        *(of[f](f"__s_{name}").over(blocks_up if side == "before" else blocks_down).alias(f"__s_{name}") for name, (f, side, _) in specs.items()),
    )
    inside = frame.select("*", *(of[f](v).over(up if side == "before" else down).alias(f"__i_{name}") for name, (f, side, v) in specs.items()))
    on = None
    for c in parts:
        same = F.col(c).eqNullSafe(F.col(f"__c_{c}"))
        on = same if on is None else on & same
    joined = inside.join(carried, on, "left")
    both = {"max": F.greatest, "min": F.least}
    return joined.select(
        *(F.col(c) for c in frame.columns), *(both[f](f"__i_{name}", f"__s_{name}").alias(name) for name, (f, _, _) in specs.items())
    )


def ledger(updates: DataFrame, keys: Sequence[str], valid: str, recorded: str, attributes: Sequence[str]) -> DataFrame:
    """The keys, attrs (struct), valid_from, valid_to, recorded_from, recorded_to; open ends are null.

    Rows with recorded_to null are what is believed now.
    """
    rows = materialize(
        updates.where(F.col(valid).isNotNull())
        .select(*keys, F.col(valid).alias("__v"), F.coalesce(F.col(recorded), F.col(valid)).alias("__r"), F.struct(*attributes).alias("__a"))
        .distinct()
        .select(
            *keys,
            F.date_trunc("month", F.col("__v")).alias("__block"),
            F.struct("__v", "__r", "__a").alias("__upd"),
            # ties in recorded time are applied in valid order
            F.struct("__r", "__v", "__a").alias("__turn"),
        )
    )
    seen = running(rows, keys, "__upd", "__block", {"__after": ("min", "after", F.col("__turn"))})
    flagged = materialize(seen.select(*rows.columns, F.coalesce(F.col("__turn") > F.col("__after"), F.lit(False)).alias("__late")))
    placed = running(
        flagged,
        keys,
        "__upd",
        "__block",
        {
            "__anchor": ("max", "before", F.when(~F.col("__late"), F.col("__upd"))),
            "__before": ("max", "before", F.col("__upd")),
        },
    )
    placed = materialize(placed)
    # in order, and right behind an update in order: it has that one as predecessor and, when recorded, no successor
    plain = ~F.col("__late") & F.col("__anchor").eqNullSafe(F.col("__before"))
    simple = placed.where(plain).select(*keys, "__upd", F.col("__before").alias("__pred"), F.lit(None).cast(rows.schema["__upd"].dataType).alias("__succ"))
    runs = placed.where(~plain)
    # without late updates there is nothing to sweep, and no Python process need start
    linked = simple if runs.isEmpty() else materialize(simple.unionByName(_sweep(runs, keys, rows.schema["__upd"].dataType)))
    opened = linked.select(
        *keys, F.col("__upd").alias("__owner"), F.col("__upd.__r").alias("recorded_from"), F.col("__upd").alias("__by"), F.col("__succ.__v").alias("valid_to")
    )
    split = linked.where(F.col("__pred").isNotNull()).select(
        *keys, F.col("__pred").alias("__owner"), F.col("__upd.__r").alias("recorded_from"), F.col("__upd").alias("__by"), F.col("__upd.__v").alias("valid_to")
    )
    # the rows of one update: as many as there were splits right behind it
    first = F.col("__by") == F.col("__owner")
    turns = Window.partitionBy(*keys, "__owner").orderBy("recorded_from", F.when(first, 0).otherwise(1), F.col("__by.__v").desc(), F.col("__by").desc())
    return (
        opened.unionByName(split)
        .withColumn("recorded_to", F.lead("recorded_from").over(turns))
        .where(
            (F.col("recorded_to").isNull() | (F.col("recorded_to") > F.col("recorded_from")))
            & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("__owner.__v")))
        )
        .select(*keys, F.col("__owner.__a").alias("attrs"), F.col("__owner.__v").alias("valid_from"), "valid_to", "recorded_from", "recorded_to")
    )


def _sweep(run_rows: DataFrame, keys: Sequence[str], spot_type) -> DataFrame:
    """Nearest rows with a smaller turn on either side, for runs of late updates and the update that ends each.

    A run hangs on the last update in order before it (``__anchor``), which is smaller than all that follow. Its length
    is the number of updates in a row that arrived late; a run is one group, never an entity.
    """
    # dense ranks stand for values, so that Python compares plain integers
    run = Window.partitionBy(*keys, "__anchor")
    ranked = run_rows.select(
        *keys,
        "__upd",
        "__anchor",
        F.row_number().over(run.orderBy("__upd")).alias("i"),
        F.row_number().over(run.orderBy("__turn")).alias("t"),
        F.sha2(F.to_json(F.struct(*keys, "__anchor")), 256).alias("__run"),
    )

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        runs, order, turn = rows["__run"].to_numpy(), rows["i"].to_numpy(), rows["t"].to_numpy()
        left, right, open_, run = [0] * len(order), [0] * len(order), [], None
        for n in range(len(order)):
            if runs[n] != run:
                run, open_ = runs[n], []
            while open_ and turn[open_[-1]] > turn[n]:
                right[open_.pop()] = int(order[n])
            left[n] = int(order[open_[-1]]) if open_ else 0
            open_.append(n)
        return pd.DataFrame({"__run": runs, "i": order, "left": left, "right": right})

    def stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come run by run; only a run that a batch breaks off is kept for the next one
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            if len(rows):
                broken = (rows["__run"] == rows["__run"].iloc[-1]).to_numpy()
                rest, whole = rows[broken], rows[~broken]
                if len(whole):
                    yield solve(whole)
        if rest is not None and len(rest):
            yield solve(rest)

    by_run = ranked.select("__run", "i", "t").repartition("__run").sortWithinPartitions("__run", "i")
    found = by_run.mapInPandas(stack, "__run string, i int, left int, right int")
    me = ranked.select(*keys, "__upd", "__anchor", F.col("__run").alias("__g"), F.col("i").alias("__i"))
    near = ranked.select(F.col("__run").alias("__n"), F.col("i").alias("__ni"), F.col("__upd").alias("__spot"))
    out = me.join(found, (F.col("__g") == F.col("__run")) & (F.col("__i") == F.col("i")))
    out = out.join(near, (F.col("__g") == F.col("__n")) & (F.col("left") == F.col("__ni")), "left").withColumn("__l", F.col("__spot")).drop("__n", "__ni", "__spot")
    out = out.join(near, (F.col("__g") == F.col("__n")) & (F.col("right") == F.col("__ni")), "left")
    return out.select(*keys, "__upd", F.coalesce("__l", "__anchor").cast(spot_type).alias("__pred"), F.col("__spot").cast(spot_type).alias("__succ"))


def _believed(book: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open rows of the ledger. It is written out, since every running value reads its input twice."""
    open_ = book.where(F.col("recorded_to").isNull())
    return materialize(open_.select(*keys, "attrs", F.struct("valid_from").alias("__at"), F.date_trunc("month", "valid_from").alias("__block")))


def versions(book: DataFrame, keys: Sequence[str], absent: str | None = None) -> DataFrame:
    """What is believed now, equal neighbours joined: the keys, attrs, valid_from, valid_to (null: until now).

    ``absent`` names a boolean attribute that marks an entity as missing; such spans end a version and are none.
    """
    now = _believed(book, keys)
    before = running(now, keys, "__at", "__block", {"__prev": ("max", "before", F.struct("__at", "attrs"))})
    starts = materialize(before.where(F.col("__prev").isNull() | ~F.col("attrs").eqNullSafe(F.col("__prev.attrs"))).select(*now.columns))
    ended = running(starts, keys, "__at", "__block", {"__next": ("min", "after", F.col("__at"))})
    out = ended.select(*keys, "attrs", F.col("__at.valid_from").alias("valid_from"), F.col("__next.valid_from").alias("valid_to"))
    return out if absent is None else out.where(~F.col(f"attrs.{absent}"))


def version_starts(book: DataFrame, keys: Sequence[str], absent: str | None = None) -> DataFrame:
    """The keys and valid_from of every version; without the pass that looks for their ends."""
    now = _believed(book, keys)
    before = running(now, keys, "__at", "__block", {"__prev": ("max", "before", F.struct("__at", "attrs"))})
    starts = before.where(F.col("__prev").isNull() | ~F.col("attrs").eqNullSafe(F.col("__prev.attrs")))
    if absent is not None:
        starts = starts.where(~F.col(f"attrs.{absent}"))
    return starts.select(*keys, F.col("__at.valid_from").alias("valid_from"))


def merge_snapshot(table: VersionedTable, current: DataFrame, keys: Sequence[str], attributes: Sequence[str], at: datetime.datetime) -> dict:
    """Keep a history by merging: the keys, attributes, valid_from, valid_to (null while current). Returns the merge's metrics.

    Current rows whose attributes changed are closed at ``at`` and opened anew, new keys are opened, and keys that are
    missing stay as they are. Only open rows are compared, and nothing is written if nothing changed. A second change at
    the same time replaces the first. ``current`` needs one row per key.
    """
    moment = F.lit(at).cast("timestamp_ntz")
    opened = current.select(*keys, *attributes, moment.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    if not table.exists():
        return table.overwrite(opened)
    held = table.read().where(F.col("valid_to").isNull()).select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(F.col(a).alias(f"__a_{a}") for a in attributes), F.col("valid_from").alias("__from"))
    on, same = None, F.lit(True)
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = one if on is None else on & one
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.col(f"__a_{a}"))
    due = materialize(opened.join(held, on, "left").where(F.col("__from").isNull() | ~same))
    closed = due.where(F.col("__from") < moment).select(
        *keys, *(F.col(f"__a_{a}").alias(a) for a in attributes), F.col("__from").alias("valid_from"), moment.alias("valid_to")
    )
    return table.merge_current(due.select(*opened.columns).unionByName(closed), [*keys, "valid_from"])


def snapshots_to_updates(snapshots: DataFrame, keys: Sequence[str], taken: str, attributes: Sequence[str]) -> DataFrame:
    """Periodic snapshots as updates: the keys, taken, attributes, absent. A key missing from the next snapshot gets an
    update with absent = true on that date, so its return starts a new version.

    The calendar of snapshots has one row per date taken; it is broadcast, being bounded by the number of dates.
    """
    present = snapshots.where(F.col(taken).isNotNull()).select(*keys, taken, *attributes, F.lit(False).alias("absent")).distinct()
    calendar = snapshots.where(F.col(taken).isNotNull()).select(F.col(taken).alias("__d")).distinct()
    following = calendar.select("__d", F.lead("__d").over(Window.orderBy("__d")).alias("__next"))
    due = present.join(F.broadcast(following), F.col(taken) == F.col("__d")).where(F.col("__next").isNotNull())
    due = due.select(*keys, F.col("__next").alias(taken)).distinct()
    there = present.select(*(F.col(k).alias(f"__p_{k}") for k in keys), F.col(taken).alias("__p_taken")).distinct()
    on = F.col(taken) == F.col("__p_taken")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__p_{k}"))
    gone = due.join(there, on, "left_anti").select(
        *keys, taken, *(F.lit(None).cast(snapshots.schema[a].dataType).alias(a) for a in attributes), F.lit(True).alias("absent")
    )
    return present.unionByName(gone)
