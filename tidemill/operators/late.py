"""Per-period aggregates by event time, corrected as late records arrive, with a cut-off.

Messages are first reduced to one contribution each (their first arrival). Contributions are stored as partial
aggregates per period and arrival batch: sums and counts, which merge by addition. A period's figures at any moment
are the sum of its partials up to that batch. A contribution that arrives after the cut-off is refused, and so is a
batch for a period that the store has closed.

Defined results: a message without event time or without arrival time has no period and gets status ``undated``;
arrivals before their event (clocks that run ahead) are on time; of several rows with the same first arrival the one
with the smallest event time counts; an order counts once, in the batch in which its first line arrived; null
quantities and prices add nothing; an empty table gives no rows.

Deliveries are merged in the order of their arrival times, each from its own raw rows, into a store that persists
(LateStore): partials, the messages seen, the (period, order) keys counted, and the closed periods. So a message
repeated in a later delivery adds nothing and an order whose lines come in two deliveries counts once. Messages are
never forgotten: a repeat may come after the cut-off, or with another event time.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import materialize
from tidemill.sources.versioned import VersionedTable

GRACE = "INTERVAL 30 MINUTES"
CUTOFF = "INTERVAL 48 HOURS"


def lateness(event: Column, arrival: Column, grace: str = GRACE, cutoff: str = CUTOFF) -> Column:
    """on_time, late (more than grace, at most cutoff), refused (beyond), or undated."""
    return (
        F.when(event.isNull() | arrival.isNull(), "undated")
        .when(arrival <= event + F.expr(grace), "on_time")
        .when(arrival <= event + F.expr(cutoff), "late")
        .otherwise("refused")
    )


def first_arrivals(
    events: DataFrame, key: Column, event: str, arrival: str, carry: Sequence[str] = (), grace: str = GRACE, cutoff: str = CUTOFF
) -> DataFrame:
    """One contribution per message: message, event_time, arrival_time, the carried columns and status.

    Repeats are combined before the shuffle, so a message that was sent a million times costs its own task one row.
    Rows whose key is null are no messages.
    """
    first = F.min(F.struct(F.col(arrival).alias("__arrived"), F.col(event).alias("__happened"), *(F.col(c) for c in carry)))
    # a null arrival sorts first in a struct; it must not win over a known one
    known = F.coalesce(
        F.min(F.when(F.col(arrival).isNotNull(), F.struct(F.col(arrival).alias("__arrived"), F.col(event).alias("__happened"), *(F.col(c) for c in carry)))),
        first,
    )
    got = events.where(key.isNotNull()).groupBy(key.alias("message")).agg(known.alias("f"))
    out = got.select("message", F.col("f.__happened").alias("event_time"), F.col("f.__arrived").alias("arrival_time"), *(F.col(f"f.{c}") for c in carry))
    return out.withColumn("status", lateness(F.col("event_time"), F.col("arrival_time"), grace, cutoff))


def partials(
    contributions: DataFrame,
    order: str | None = "order_id",
    units: str | None = "quantity",
    price: str | None = "price",
    batch: str = "hour",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Partial aggregates: one row per period (day of event time) and arrival batch (hour by default) of accepted contributions.

    Orders whose keys (period, order_key) are in counted were counted by an earlier delivery and aren't counted again.
    Without the column of orders, units or prices their figures are 0.
    """
    number = F.col(units).cast("long") if units else F.lit(0).cast("long")
    accepted = contributions.where(F.col("status").isin("on_time", "late")).select(
        F.to_date("event_time").alias("period"),
        F.date_trunc(batch, "arrival_time").cast("timestamp_ntz").alias("arrival_batch"),
        (F.col(order) if order else F.lit(None).cast("string")).alias("order_key"),
        number.alias("units"),
        (number * F.col(price).cast("decimal(12,2)") if price else F.lit(0)).cast("decimal(28,2)").alias("revenue"),
        "arrival_time",
        (F.col("status") == "late").alias("is_late"),
    )
    sums = accepted.groupBy("period", "arrival_batch").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("is_late").alias("late_lines"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(38,2)").alias("revenue"),
        F.max("arrival_time").alias("last_arrival"),
    )
    if not order:
        return sums.select("period", "arrival_batch", F.lit(0).cast("long").alias("orders"), "lines", "late_lines", "units", "revenue", "last_arrival")
    # an order is counted in the batch of its first line: that makes a distinct count a sum
    per_order = accepted.groupBy("period", "order_key").agg(F.min("arrival_batch").alias("arrival_batch"))
    if counted is not None:
        per_order = per_order.join(counted, ["period", "order_key"], "left_anti")
    new_orders = per_order.where(F.col("order_key").isNotNull()).groupBy("period", "arrival_batch").agg(F.count(F.lit(1)).alias("orders"))
    return sums.join(new_orders, ["period", "arrival_batch"], "left").select(
        "period", "arrival_batch", F.coalesce("orders", F.lit(0)).alias("orders"), "lines", "late_lines", "units", "revenue", "last_arrival"
    )


def combine(store: DataFrame) -> DataFrame:
    """Combine on read: the figures of each period as they stand after all batches."""
    return store.groupBy("period").agg(
        F.sum("orders").alias("orders"),
        F.sum("lines").alias("lines"),
        F.sum("late_lines").alias("late_lines"),
        F.sum("units").alias("units"),
        F.sum("revenue").cast("decimal(38,2)").alias("revenue"),
        F.max("last_arrival").alias("last_arrival"),
    )


def corrections(store: DataFrame) -> DataFrame:
    """The figures of each period after each arrival batch. A period has as many rows as batches up to the cut-off."""
    after = Window.partitionBy("period").orderBy("arrival_batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return store.select(
        "period",
        "arrival_batch",
        *(F.sum(c).over(after).alias(c) for c in ("orders", "lines", "late_lines", "units")),
        F.sum("revenue").over(after).cast("decimal(38,2)").alias("revenue"),
    )


def _refused(verdict: Column) -> Column:
    return verdict.isin("refused", "closed")


class LateStore:
    """What persists between deliveries, as versioned tables below one folder.

    * messages: every message seen, with its period, arrival batch and verdict (on_time, late, refused, closed, unwanted);
    * partials: the mergeable partial aggregates, appended per delivery and added up on read;
    * orders: the (period, order_key) counted so far;
    * commits: per delivery the versions of the other tables and the day closed through, in the log of a table without rows.

    A delivery is in force once its commit is. What a crash left in the other tables before that is taken back by
    the next delivery, and a delivery that is repeated under its name changes nothing.
    """

    _TABLES = ("messages", "partials", "orders")

    def __init__(self, spark: SparkSession, path: str):
        at = lambda n: VersionedTable(spark, f"{path.rstrip('/')}/{n}")
        self.spark, self.commits = spark, at("commits")
        self.tables = {n: at(n) for n in self._TABLES}

    def _last(self) -> dict | None:
        """The newest commit: versions of the tables, closed_through (text or None), and the names of all deliveries."""
        return self.commits.manifest()["properties"] if self.commits.exists() else None

    def read(self, name: str) -> DataFrame:
        """A table as of the newest commit."""
        last = self._last()
        if last is None:
            raise FileNotFoundError("nothing delivered yet")
        return self.tables[name].read(last[name])

    def figures(self) -> DataFrame:
        """Combine on read."""
        return combine(self.read("partials"))

    def late_messages(self) -> DataFrame:
        """message, event_time, arrival_time, period of late messages in the batches that the store accepted.

        The cells (period, arrival batch) with late lines are at most periods times the hours up to the cut-off.
        """
        cells = self.read("partials").where(F.col("late_lines") > 0).select("period", "arrival_batch").distinct()
        found = self.read("messages").where(F.col("verdict") == "late").join(cells, ["period", "arrival_batch"], "left_semi")
        return found.select("message", "event_time", "arrival_time", "period")

    def refused_messages(self) -> DataFrame:
        """message, event_time, arrival_time, period, verdict: beyond the cut-off (refused) or of a closed period (closed)."""
        return self.read("messages").where(_refused(F.col("verdict"))).select("message", "event_time", "arrival_time", "period", "verdict")

    def deliver(
        self, name: str, delivered: DataFrame, only: Column | None = None, close_through: datetime.date | None = None,
        order: str | None = "order_id", units: str | None = "quantity", price: str | None = "price", batch: str = "hour",
    ) -> None:
        """Merge one delivery, given as the first arrivals of its own raw rows.

        Messages of earlier deliveries add nothing, whatever they say now; one without arrival time is not yet seen. Of
        the new messages those that match ``only`` are contributions, the others are seen all the same. Periods up to
        ``close_through`` are closed once the delivery is in force: later ones find them closed, within the cut-off or not.
        """
        last = self._last()
        if last is not None and name in last["deliveries"]:
            return
        for n, table in self.tables.items():
            if table.exists() and (last is None or table.versions()[-1] != last[n]):
                table.restore(last[n] if last else None)
        closed = last and last["closed_through"]
        known = delivered.where(F.col("arrival_time").isNotNull())
        if last is not None:
            known = self._unseen(known)
        period = F.to_date("event_time")
        shut = F.lit(False) if closed is None else F.coalesce(period <= F.lit(closed).cast("date"), F.lit(False))
        wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
        verdict = F.when(~wanted, "unwanted").when((F.col("status") != "refused") & (F.col("status") != "undated") & shut, "closed").otherwise(F.col("status"))
        kept = [c for c in (order, units, price) if c]
        since = self.tables["messages"].versions()[-1] if self.tables["messages"].exists() else None
        self.tables["messages"].append(
            known.select(
                "message", "event_time", "arrival_time", period.alias("period"), F.date_trunc(batch, "arrival_time").cast("timestamp_ntz").alias("arrival_batch"),
                verdict.alias("verdict"), *(F.when(verdict.isin("on_time", "late"), F.col(c)).alias(c) for c in kept),
            )
        )
        # the rows just written, so that nothing is worked out twice
        accepted = self.tables["messages"].added(since).where(F.col("verdict").isin("on_time", "late")).withColumn("status", F.col("verdict"))
        counted = None if last is None or not order else self.read("orders")
        self.tables["partials"].append(partials(accepted, order, units, price, batch, counted))
        if order:
            keys = accepted.select("period", F.col(order).alias("order_key")).where(F.col("order_key").isNotNull()).distinct()
            self.tables["orders"].append(keys if counted is None else keys.join(counted, ["period", "order_key"], "left_anti"))
        else:
            self.tables["orders"].create(accepted.select("period", F.lit("").alias("order_key")).schema)
        versions = {n: t.versions()[-1] for n, t in self.tables.items()}
        days = [d for d in (closed, close_through and close_through.isoformat()) if d]
        self.commits.mark(versions | {"closed_through": max(days, default=None), "deliveries": [*(last["deliveries"] if last else []), name]})

    def _unseen(self, known: DataFrame) -> DataFrame:
        """Rows of messages that the store lacks. The store's ids are filtered by those that arrive first, so they are
        shuffled only where the delivery is too large to be sent to them."""
        known = materialize(known)
        seen = self.read("messages").select("message").join(known.select("message"), "message", "left_semi")
        return known.join(seen, "message", "left_anti")
