"""Queries pN_... of the general problems: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.identifiers import uuid_bytes, uuid_text
from tidemill.operators import compare, dedup, history, late, orphans, parse, skew
from tidemill.session import work_path
from tidemill.sources.tables import load, table_path

TIME = "yyyy-MM-dd HH:mm:ss"


def day(c):
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


# 1 ------------------------------------------------------------------------------------------------------------------


def _p1(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, key in (("fact_order_items", "order_item_id"), ("daily_sales", "order_date")):
        found = compare.differences(load(spark, sf, name), load(spark, sf, f"{name}_copy"), key)
        # a key kept as a timestamp for comparison is still a date to its reader
        shown = F.col(key) if name != "daily_sales" else day(F.col(key))
        part = found.select(F.lit(name).alias("table_name"), shown.alias("row_key"), "field_name", "base_value", "copy_value")
        out = part if out is None else out.unionAll(part)
    return out


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p1(spark, sf).select("table_name", "row_key", "field_name")


def p1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _p1(spark, sf).groupBy("table_name", "field_name").agg(F.count(F.lit(1)).alias("cases"))


# 2 ------------------------------------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf: str, carry: tuple[str, ...] = ()) -> DataFrame:
    events = load(spark, sf, "silver_events")
    return late.first_arrivals(events, uuid_bytes(F.col("event_id")), "event_timestamp", "ingestion_timestamp", carry)


def _late_store(spark: SparkSession) -> late.LateStore:
    return late.LateStore(spark, work_path(spark, "late"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Late messages of the batches that a store accepted which took all events as its first delivery."""
    store = _late_store(spark)
    store.deliver("all", _messages(spark, sf), order=None, units=None, price=None)
    return store.late_messages().select(uuid_text(F.col("message")).alias("event_id"), day("period").alias("event_date"))


def _store(spark: SparkSession, sf: str) -> DataFrame:
    bought = _messages(spark, sf, ("event_type", "order_id", "quantity", "price")).where(F.col("event_type") == "purchase")
    return late.partials(bought)


def p2_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily figures of purchases as they stand after all records up to the cut-off."""
    return late.combine(_store(spark, sf)).select(
        F.col("period").alias("order_date"),
        F.col("orders").cast("long").alias("orders"),
        F.col("units").cast("long").alias("units"),
        F.col("revenue").cast("decimal(18,2)").alias("revenue"),
        F.col("late_lines").cast("long").alias("late_lines"),
    )


def p2_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Daily figures as they stand after each arrival batch (hour of ingestion)."""
    return late.corrections(_store(spark, sf)).select(
        F.col("period").alias("order_date"),
        "arrival_batch",
        F.col("orders").cast("long").alias("orders"),
        F.col("units").cast("long").alias("units"),
        F.col("revenue").cast("decimal(18,2)").alias("revenue"),
    )


#: Where the deliveries of p2_incremental and p2_refused are cut, by ingestion time: at no particular moments.
CUTS = ("2015-01-06 03:17:41", "2015-01-15 12:07:00", "2015-02-02 00:00:01", "2015-02-10 12:07:00", "2015-02-27 23:59:59")


def _delivered(spark: SparkSession, sf: str, close_after: datetime.timedelta) -> late.LateStore:
    """Six deliveries, each from its own raw rows, merged one after the other. With each, the days that ended more than
    ``close_after`` before its end are closed."""
    events, store = load(spark, sf, "silver_events"), _late_store(spark)
    at = F.coalesce(F.col("ingestion_timestamp"), F.lit("0001-01-01").cast("timestamp_ntz"))
    for n, (begin, end) in enumerate(zip((None, *CUTS), (*CUTS, None), strict=True)):
        rows = events
        if begin:
            rows = rows.where(F.col("ingestion_timestamp") >= F.lit(begin).cast("timestamp_ntz"))
        if end:
            rows = rows.where(at < F.lit(end).cast("timestamp_ntz"))
        got = late.first_arrivals(rows, uuid_bytes(F.col("event_id")), "event_timestamp", "ingestion_timestamp", ("event_type", "order_id", "quantity", "price"))
        through = end and (datetime.datetime.fromisoformat(end) - close_after).date() - datetime.timedelta(days=1)
        store.deliver(f"delivery-{n}", got, F.col("event_type") == "purchase", through)
    return store


def p2_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Daily figures from six deliveries merged one after the other; equals p2_daily."""
    return _delivered(spark, sf, datetime.timedelta(hours=48)).figures().select(
        F.col("period").alias("order_date"),
        F.col("orders").cast("long").alias("orders"),
        F.col("units").cast("long").alias("units"),
        F.col("revenue").cast("decimal(18,2)").alias("revenue"),
        F.col("late_lines").cast("long").alias("late_lines"),
    )


def p2_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases that six deliveries refused, beyond the cut-off or of a day closed already (here 12 hours after its end)."""
    refused = _delivered(spark, sf, datetime.timedelta(hours=12)).refused_messages()
    return refused.select(uuid_text(F.col("message")).alias("event_id"), day("period").alias("event_date"), F.col("verdict").alias("reason"))


# 3 ------------------------------------------------------------------------------------------------------------------


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, spread in (("silver_events", ("event_id",)), ("silver_orders", ("order_id",))):
        heavy = skew.heavy_report(load(spark, sf, name), "country", 0.05, spread)
        part = heavy.select(F.lit(name).alias("table_name"), "country")
        out = part if out is None else out.unionAll(part)
    return out


def p3_country_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures per country of all events: rows, units, newest arrival, exact numbers of customers and products."""
    figures = skew.salted_aggregate(
        load(spark, sf, "silver_events"),
        "country",
        sums={"units": F.col("quantity").cast("long")},
        maxima={"last_ingestion": F.col("ingestion_timestamp")},
        distinct={"customers": "customer_id", "products": "product_id"},
        spread=("event_id",),
    )
    return figures.select("country", F.col("n").alias("events"), "units", "last_ingestion", F.col("customers").cast("long").alias("customers"), F.col("products").cast("long").alias("products"))


# 4 ------------------------------------------------------------------------------------------------------------------


def _silver_id(frame: DataFrame):
    return uuid_bytes(frame["event_id"])


def _bronze_id(frame: DataFrame):
    return uuid_bytes(F.get_json_object(frame["raw_payload"], "$.event_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that lie in two or more rows: those of the rows that the deletion vectors mark."""
    out = None
    for name, key in (("silver_events", _silver_id), ("bronze_events", _bronze_id)):
        many = dedup.marked_messages(spark, table_path(sf, name), key, ("ingestion_timestamp",))
        part = many.select(F.lit(name).alias("table_name"), uuid_text(F.col("message")).alias("event_id"))
        out = part if out is None else out.unionAll(part)
    return out


def p4_silver_once(spark: SparkSession, sf: str) -> DataFrame:
    """silver_events with one row per message, the first delivery."""
    return dedup.keep_first(spark, table_path(sf, "silver_events"), _silver_id, ("ingestion_timestamp", "event_id", "country"))


def p4_bronze_once(spark: SparkSession, sf: str) -> DataFrame:
    """bronze_events with one row per message; payloads without a readable UUID stay."""
    return dedup.keep_first(spark, table_path(sf, "bronze_events"), _bronze_id, ("ingestion_timestamp", "topic", "kafka_partition", "kafka_offset"))


# 5 ------------------------------------------------------------------------------------------------------------------


def _product_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return history.ledger(load(spark, sf, "products"), ["product_id"], "ingestion_timestamp", "ingestion_timestamp", ["description", "unit_price"])


def _dim_ledger(spark: SparkSession, sf: str) -> DataFrame:
    updates = history.snapshots_to_updates(load(spark, sf, "dim_product"), ["product_id"], "snapshot_date", ["average_price"])
    return history.ledger(updates, ["product_id"], "snapshot_date", "snapshot_date", ["average_price", "absent"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    by_update = history.version_starts(_product_ledger(spark, sf), ["product_id"])
    by_snapshot = history.version_starts(_dim_ledger(spark, sf), ["product_id"], absent="absent")
    return by_update.select(F.lit("products").alias("table_name"), "product_id", F.date_format("valid_from", TIME).alias("valid_from")).unionAll(
        by_snapshot.select(F.lit("dim_product").alias("table_name"), "product_id", day("valid_from").alias("valid_from"))
    )


def p5_product_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.versions(_product_ledger(spark, sf), ["product_id"]).select("product_id", "attrs.description", "attrs.unit_price", "valid_from", "valid_to")


def p5_price_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.versions(_dim_ledger(spark, sf), ["product_id"], absent="absent").select("product_id", "attrs.average_price", "valid_from", "valid_to")


def p5_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """All beliefs, superseded ones included."""
    return _product_ledger(spark, sf).select("product_id", "attrs.description", "attrs.unit_price", "valid_from", "valid_to", "recorded_from", "recorded_to")


def _event_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Prices per product as events told them: valid from the event's time, recorded at its ingestion, so that late and
    out-of-order events split intervals that were believed before."""
    told = load(spark, sf, "silver_events").where(F.col("price").isNotNull() & F.col("product_id").isNotNull())
    return history.ledger(told.select("product_id", "event_timestamp", "ingestion_timestamp", "price"), ["product_id"], "event_timestamp", "ingestion_timestamp", ["price"])


def p5_event_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _event_ledger(spark, sf).select("product_id", "attrs.price", "valid_from", "valid_to", "recorded_from", "recorded_to")


def p5_event_prices(spark: SparkSession, sf: str) -> DataFrame:
    return history.versions(_event_ledger(spark, sf), ["product_id"]).select("product_id", "attrs.price", "valid_from", "valid_to")


# 6 ------------------------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse.rejected(load(spark, sf, "quarantine")).select("record_id")


def p6_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return parse.rejected(load(spark, sf, "quarantine")).select("record_id", "source_file", "line_number", "raw_payload", "error_type", "error_message")


def p6_error_types(spark: SparkSession, sf: str) -> DataFrame:
    return parse.rejected(load(spark, sf, "quarantine")).select("record_id", "error_type")


def p6_invoices(spark: SparkSession, sf: str) -> DataFrame:
    good = parse.loaded(load(spark, sf, "quarantine")).where(F.col("record_format") == "csv")
    return good.select("record_id", "loaded_invoice.*")


def p6_events(spark: SparkSession, sf: str) -> DataFrame:
    good = parse.loaded(load(spark, sf, "quarantine")).where(F.col("record_format") == "json")
    return good.select("record_id", "loaded_event.*")


# 7 ------------------------------------------------------------------------------------------------------------------

_REFS = (
    ("silver_orders", "order_id", "customer_id", "customers", "customer_id", "deleted_at"),
    ("order_items", "_record_hash", "order_id", "silver_orders", "order_id", None),
    ("order_items", "_record_hash", "product_id", "products", "product_id", None),
)


def _p7(spark: SparkSession, sf: str):
    for table, row_key, ref, parent, key, died in _REFS:
        refs = load(spark, sf, table).select(*dict.fromkeys((row_key, ref, "ingestion_timestamp")))
        yield table, row_key, ref, orphans.orphans(refs, ref, "ingestion_timestamp", load(spark, sf, parent), key, "ingestion_timestamp", died)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table, row_key, ref, found in _p7(spark, sf):
        part = found.select(F.lit(table).alias("table_name"), F.col(row_key).alias("row_key"), F.lit(ref).alias("ref_column")).distinct()
        out = part if out is None else out.unionAll(part)
    return out


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table, _, ref, found in _p7(spark, sf):
        part = orphans.report(found, table, ref)
        out = part if out is None else out.unionAll(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_summary, p2_found, p2_daily, p2_corrections, p2_incremental, p2_refused, p3_found, p3_country_figures, p4_found, p4_silver_once, p4_bronze_once,
        p5_found, p5_product_history, p5_price_history, p5_ledger, p5_event_ledger, p5_event_prices, p6_found, p6_rejected, p6_error_types, p6_invoices, p6_events, p7_found, p7_report,
    )
}
