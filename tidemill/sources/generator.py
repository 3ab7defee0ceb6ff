"""Seeded retail events as a DataFrame: made in parallel, the same for the same parameters at any number of tasks.

Every value is a hash of the seed, a salt and the event number, so no state is carried from row to row. Scenarios:
normal, duplicate (every third event is sent again), late-data (every third is 31 to 180 minutes old), malformed (every
fourth is broken), traffic-spike (ten times the events) and checkpoint-recovery (as normal).
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.contract import expected_topic
from tidemill.functions.identifiers import dashed

SCENARIOS = ("normal", "duplicate", "late-data", "malformed", "traffic-spike", "checkpoint-recovery")
# Event types and their weights in percent.
WEIGHTS = (("product_view", 30), ("search", 12), ("add_to_cart", 20), ("checkout", 8), ("purchase", 12), ("payment", 10), ("inventory_update", 8))
COUNTRIES = ("Ireland", "Austria", "Finland", "Kenya", "Peru", "Japan")
#: Above this many events a caller must say that the volume is meant.
GUARDED = 100_000


def _hash(seed: int, salt: str, *of: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *of), F.lit(2**31))


def events(spark: SparkSession, count: int, scenario: str = "normal", seed: int = 42, now: datetime.datetime | None = None, confirm: bool = False) -> DataFrame:
    """raw_payload, topic, n (delivery order) of ``count`` events; sent ones, repeats included, may be more."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario}")
    made = count * 10 if scenario == "traffic-spike" else count
    if made > GUARDED and not confirm:
        raise ValueError(f"{made} events need confirm=True")
    now = now or datetime.datetime(2026, 1, 1)
    n = F.col("id")
    pick, kind, upto = _hash(seed, "type", n) % 100, None, 0
    for name, weight in WEIGHTS:
        upto += weight
        kind = F.when(pick < upto, name) if kind is None else kind.when(pick < upto, name)
    customer = _hash(seed, "customer", n) % 500
    order = _hash(seed, "order", n) % 400
    base = spark.range(made).select(
        "id",
        kind.alias("event_type"),
        dashed(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(scenario), n.cast("string")), 256), 1, 32)).alias("event_id"),
        customer.alias("customer"),
        order.alias("order"),
        (_hash(seed, "product", n) % 60).alias("product"),
        (_hash(seed, "quantity", n) % 5 + 1).cast("int").alias("quantity"),
        ((_hash(seed, "price", n) % 9900 + 100) / 100).cast("decimal(12,2)").cast("string").alias("price"),
        (_hash(seed, "late", n) % 150 + 31).cast("int").alias("late_minutes"),
    )
    ordered = F.col("event_type").isin("checkout", "purchase", "payment")
    # a customer's country and an order's customer follow from their ids
    owner = F.when(ordered, _hash(seed, "owner", F.col("order")) % 500).otherwise(F.col("customer"))
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (_hash(seed, "country", owner) % len(COUNTRIES) + 1).cast("int"))
    late = F.lit(scenario == "late-data") & (n % 3 == 2)
    at = F.lit(now) - F.make_dt_interval(secs=(n % 60).cast("decimal(18,6)")) - F.make_dt_interval(mins=F.when(late, F.col("late_minutes")).otherwise(0))
    has_product = F.col("event_type").isin("product_view", "add_to_cart", "purchase", "inventory_update")
    payload = F.to_json(
        F.struct(
            "event_id",
            "event_type",
            F.when(F.col("event_type") != "inventory_update", F.concat(F.lit("CUST-"), F.lpad(owner.cast("string"), 6, "0"))).alias("customer_id"),
            F.when(has_product, F.concat(F.lit("PROD-"), F.lpad(F.col("product").cast("string"), 5, "0"))).alias("product_id"),
            F.when(ordered, F.concat(F.lit("ORD-"), F.lpad(F.col("order").cast("string"), 7, "0"))).alias("order_id"),
            F.when(F.col("event_type").isin("purchase", "inventory_update", "add_to_cart"), F.col("quantity")).alias("quantity"),
            F.when(F.col("event_type").isin("purchase", "add_to_cart"), F.col("price")).alias("price"),
            country.alias("country"),
            F.when(F.col("event_type") == "search", F.concat(F.lit("query "), (n % 17).cast("string"))).alias("query"),
            F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_timestamp"),
            F.lit(1).alias("schema_version"),
        ),
        {"ignoreNullFields": "false"},
    )
    broken = F.lit(scenario == "malformed") & (n % 4 == 3)
    out = base.select(n, F.when(broken, F.regexp_replace(payload, '"schema_version":1', '"schema_version":"1"')).otherwise(payload).alias("raw_payload"), expected_topic(F.col("event_type")).alias("topic"))
    times = F.when(F.lit(scenario == "duplicate") & (n % 3 == 2), 2).otherwise(1)
    return out.select("raw_payload", "topic", (n * 2).alias("n"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("raw_payload", "topic", (F.col("n") + F.col("copy") - 1).alias("n"))
