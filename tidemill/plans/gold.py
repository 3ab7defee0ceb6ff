"""The star schema over Silver tables: dimensions, facts and marts as DataFrame functions.

Each takes DataFrames and returns one, so incremental runs, full refreshes and streams share them. Money is exact
decimal throughout: unit prices are rounded half up to cents before they are multiplied, and products are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.identifiers import uuid_bytes, uuid_text
from tidemill.session import materialize

MONEY = "decimal(12,2)"
TOTAL = "decimal(18,2)"


def stg_events(silver: DataFrame) -> DataFrame:
    """Typed events, one per message: the first arrival, then the smallest row. Only named columns are shuffled."""
    columns = ("event_timestamp", "event_type", "customer_id", "product_id", "order_id", "country")
    row = F.struct("ingestion_timestamp", *columns, F.col("quantity").cast("int").alias("quantity"), F.col("price").cast(MONEY).alias("price"))
    first = silver.groupBy(uuid_bytes(F.col("event_id")).alias("k")).agg(F.min(row).alias("r")).where(F.col("k").isNotNull())
    return first.select(uuid_text(F.col("k")).alias("event_id"), "r.*")


def line_total(quantity: Column, price: Column) -> Column:
    return (quantity.cast("long") * price.cast(MONEY)).cast(TOTAL)


def purchases(stg: DataFrame) -> DataFrame:
    return stg.where(F.col("event_type") == "purchase").withColumn("line_total", line_total(F.col("quantity"), F.col("price")))


def current_orders(orders: DataFrame, columns: Sequence[str] = ("customer_id", "order_timestamp", "country")) -> DataFrame:
    """One row per order: the one ingested last (of equal times the greatest). Only the named columns are read."""
    rest = list(columns)
    last = orders.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.max(F.struct("ingestion_timestamp", *rest)).alias("r"))
    return last.select("order_id", "r.*")


def current_products(products: DataFrame) -> DataFrame:
    """The attributes that each product has now: of the row ingested last."""
    last = products.where(F.col("product_id").isNotNull()).groupBy("product_id")
    return last.agg(F.max(F.struct("ingestion_timestamp", "description", "unit_price")).alias("r")).select("product_id", "r.*")


def distinct_items(items: DataFrame) -> DataFrame:
    """One row per _record_hash: its first delivery."""
    rest = ("order_id", "product_id", "quantity", "unit_price")
    return items.groupBy("_record_hash").agg(F.min(F.struct("ingestion_timestamp", *rest)).alias("r")).select("_record_hash", "r.*")


def fact_order_items_from_events(stg: DataFrame) -> DataFrame:
    return purchases(stg).select(
        F.col("event_id").alias("order_item_id"), "order_id", "customer_id", "product_id", "quantity", F.col("price").alias("unit_price"),
        "line_total", "country", "event_timestamp", "ingestion_timestamp",
    )


def fact_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    o = orders.select(F.col("order_id").alias("o_id"), "customer_id", "country", "order_timestamp", F.col("ingestion_timestamp").alias("o_ingested"))
    return items.join(o, F.col("order_id") == F.col("o_id")).select(
        F.col("_record_hash").alias("order_item_id"), "order_id", "customer_id", "product_id", "quantity", "unit_price",
        line_total(F.col("quantity"), F.col("unit_price")).alias("line_total"), "country", F.col("order_timestamp").alias("event_timestamp"),
        F.greatest("ingestion_timestamp", "o_ingested").alias("ingestion_timestamp"),
    )


def fact_orders_from_events(stg: DataFrame) -> DataFrame:
    return purchases(stg).groupBy("order_id").agg(
        # an empty text is no value
        F.max(F.nullif("customer_id", F.lit(""))).alias("customer_id"),
        F.min("event_timestamp").alias("order_timestamp"),
        F.max(F.nullif("country", F.lit(""))).alias("country"),
        F.sum("quantity").alias("units"),
        F.sum("line_total").cast(TOTAL).alias("order_total"),
        F.max("ingestion_timestamp").alias("ingestion_timestamp"),
    )


def fact_orders(items: DataFrame, orders: DataFrame) -> DataFrame:
    """The header row of an order decides customer, time and country. Items are summed before the join."""
    sums = items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.sum(F.col("quantity").cast("long")).alias("units"),
        F.sum(line_total(F.col("quantity"), F.col("unit_price"))).cast(TOTAL).alias("order_total"),
        F.max("ingestion_timestamp").alias("i_ingested"),
    )
    return orders.join(sums, "order_id").select(
        "order_id", "customer_id", "order_timestamp", "country", "units", "order_total", F.greatest("i_ingested", "ingestion_timestamp").alias("ingestion_timestamp")
    )


def daily_sales(orders: DataFrame) -> DataFrame:
    """Per day of the order; the average is the exact sum over the count, as a double."""
    total, n = F.sum("order_total"), F.count(F.lit(1))
    return orders.groupBy(F.to_date("order_timestamp").alias("order_date")).agg(
        n.alias("orders"),
        F.sum("units").alias("units"),
        total.cast(TOTAL).alias("revenue"),
        (total.cast("double") / n).alias("average_order_value"),
        F.max("ingestion_timestamp").alias("ingestion_timestamp"),
    )


def dim_customer_from_events(stg: DataFrame) -> DataFrame:
    known = stg.where(F.col("customer_id").isNotNull())
    return known.groupBy("customer_id").agg(
        F.max("country").alias("country"), F.min("event_timestamp").alias("first_seen_at"), F.max("event_timestamp").alias("last_seen_at")
    )


def dim_customer(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with their first and last order, else their own ingestion. Orders are combined before the join."""
    seen = orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.min("order_timestamp").alias("first"), F.max("order_timestamp").alias("last"))
    return customers.join(seen, "customer_id", "left").select(
        "customer_id", "country", F.coalesce("first", "ingestion_timestamp").alias("first_seen_at"), F.coalesce("last", "ingestion_timestamp").alias("last_seen_at")
    )


def dim_product_from_events(stg: DataFrame) -> DataFrame:
    known = stg.where(F.col("product_id").isNotNull())
    return known.groupBy("product_id").agg(
        F.min("event_timestamp").alias("first_seen_at"),
        F.max("event_timestamp").alias("last_seen_at"),
        F.try_divide(F.sum("price").cast("double"), F.count("price")).alias("average_price"),
    )


def dim_product(products: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Catalogue products with first and last sale (items, then their orders), else their own ingestion."""
    times = orders.select("order_id", "order_timestamp")
    sold = items.where(F.col("product_id").isNotNull()).select("product_id", "order_id").distinct().join(times, "order_id")
    seen = sold.groupBy("product_id").agg(F.min("order_timestamp").alias("first"), F.max("order_timestamp").alias("last"))
    return products.join(seen, "product_id", "left").select(
        "product_id",
        F.coalesce("first", "ingestion_timestamp").alias("first_seen_at"),
        F.coalesce("last", "ingestion_timestamp").alias("last_seen_at"),
        F.col("unit_price").cast(MONEY).alias("average_price"),
    )


def dim_date(facts: DataFrame, column: str = "order_timestamp") -> DataFrame:
    """Every day between the first and the last; no facts, no days."""
    bounds = facts.agg(F.min(F.to_date(column)).alias("a"), F.max(F.to_date(column)).alias("b")).where(F.col("a").isNotNull())
    d = F.col("date_key")
    return bounds.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("date_key")).select(
        "date_key", F.year(d).alias("calendar_year"), F.quarter(d).alias("calendar_quarter"), F.month(d).alias("calendar_month"),
        F.dayofmonth(d).alias("calendar_day"), F.date_format(d, "EEEE").alias("day_name"),
    )


def customer_360(dim: DataFrame, orders: DataFrame) -> DataFrame:
    sums = orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count("order_id").alias("n"), F.sum("order_total").alias("v"))
    return dim.join(sums, "customer_id", "left").select(
        "customer_id", "country", "first_seen_at", "last_seen_at", F.coalesce("n", F.lit(0)).alias("lifetime_orders"), F.coalesce("v", F.lit(0)).cast(TOTAL).alias("lifetime_value")
    )


def inventory_health(stg: DataFrame, as_of: Column, fresh_minutes: int = 60) -> DataFrame:
    """Every product of any event; whole minutes since its last inventory update, and the status that follows."""
    update = F.col("event_type") == "inventory_update"
    seen = stg.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.sum(F.when(update, F.col("quantity").cast("long")).otherwise(0)).alias("units_updated"),
        F.max(F.when(update, F.col("event_timestamp"))).alias("last_inventory_update"),
    )
    minutes = F.timestamp_diff("MINUTE", F.col("last_inventory_update"), as_of)
    status = F.when(minutes.isNull(), "unknown").when(minutes > fresh_minutes, "stale").otherwise("healthy")
    return seen.select("*", minutes.alias("freshness_minutes"), status.alias("inventory_status"))


# incremental -----------------------------------------------------------------------------------------------------


def high_water(stored: DataFrame, column: str = "ingestion_timestamp"):
    """The newest stored time, as a literal: it prunes files of the source. Rows at that very time are read again."""
    return stored.agg(F.max(column).alias("m")).first()["m"]


def changed_orders(items: DataFrame, orders: DataFrame, since) -> DataFrame:
    """Ids of orders with a new header or a new line since the high-water mark (inclusive)."""
    if since is None:
        return orders.select("order_id").union(items.select("order_id")).distinct()
    new = [f.where(F.col("ingestion_timestamp") >= F.lit(since)).select("order_id") for f in (orders, items)]
    return new[0].union(new[1]).distinct()


def _changed(items: DataFrame, orders: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current items and orders of the changed orders, and what is stored of them.

    ``items`` and ``orders`` are the raw tables: the high-water mark is pushed to their scans as a literal, and only rows
    of changed orders are brought to one row per key.
    """
    ids = materialize(changed_orders(items, orders, high_water(stored)).where(F.col("order_id").isNotNull()))
    of = lambda frame: frame.join(ids, "order_id", "left_semi")
    return distinct_items(of(items)), current_orders(of(orders)), of(stored)


def fact_orders_delta(items: DataFrame, orders: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of fact_orders that differ from what is stored, from the raw tables: whole orders are recomputed, unchanged ones drop out."""
    items, orders, before = _changed(items, orders, stored)
    fresh = fact_orders(items, orders)
    return fresh.subtract(before.select(*fresh.columns))


def fact_order_items_delta(items: DataFrame, orders: DataFrame, stored: DataFrame) -> DataFrame:
    """The same for fact_order_items."""
    items, orders, before = _changed(items, orders, stored)
    fresh = fact_order_items(items, orders)
    return fresh.subtract(before.select(*fresh.columns))


def changed_days(delta: DataFrame, before: DataFrame) -> DataFrame:
    """order_date of every day that changed orders are on now or were on before."""
    then = before.join(delta.select("order_id"), "order_id", "left_semi")
    return delta.select(F.to_date("order_timestamp").alias("order_date")).union(then.select(F.to_date("order_timestamp"))).distinct()


def apply_delta(stored: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key isn't in the delta, and the delta."""
    return stored.join(delta.select(key), key, "left_anti").unionByName(delta)


def without_parent(sales: DataFrame, orders: DataFrame) -> DataFrame:
    """Days that no order has any more: what has to be deleted before corrected days are merged."""
    days = orders.select(F.to_date("order_timestamp").alias("d")).distinct()
    return sales.join(days, F.col("order_date") == F.col("d"), "left_anti")
