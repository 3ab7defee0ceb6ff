"""Reports over the star schema: totals, top lists, rates, reconciliation, data tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.gold import MONEY, TOTAL


def summary(orders: DataFrame) -> DataFrame:
    """Always one row."""
    n = F.count(F.lit(1))
    return orders.agg(
        n.alias("orders"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        F.coalesce(F.sum("order_total"), F.lit(0)).cast(TOTAL).alias("revenue"),
        F.coalesce(F.try_divide(F.sum("order_total").cast("double"), n), F.lit(0.0)).alias("average_order_value"),
        F.min(F.to_date("order_timestamp")).alias("window_start"),
        F.max(F.to_date("order_timestamp")).alias("window_end"),
        F.max("ingestion_timestamp").alias("updated_at"),
    )


def conversion(events: DataFrame) -> DataFrame:
    """Views, purchases and their ratio to four places: null without views, above 1 if it is so."""
    views, bought = F.count_if(F.col("event_type") == "product_view"), F.count_if(F.col("event_type") == "purchase")
    ratio = F.try_divide(bought.cast("decimal(20,0)"), views.cast("decimal(20,0)")).cast("decimal(20,4)")
    return events.agg(views.alias("product_views"), bought.alias("purchases"), ratio.alias("ratio"))


def by_country(orders: DataFrame, n: int = 12) -> DataFrame:
    made = orders.groupBy("country").agg(F.count(F.lit(1)).alias("orders"), F.sum("order_total").cast(TOTAL).alias("revenue"))
    return made.orderBy(F.col("revenue").desc(), F.col("country").asc_nulls_first()).limit(n)


def by_product(items: DataFrame, n: int = 10) -> DataFrame:
    made = items.groupBy("product_id").agg(F.sum(F.col("quantity").cast("long")).alias("units"), F.sum("line_total").cast(TOTAL).alias("revenue"))
    return made.orderBy(F.col("revenue").desc(), F.col("product_id").asc_nulls_first()).limit(n)


def by_product_cents(items: DataFrame, n: int = 10) -> DataFrame:
    """Revenue in whole cents."""
    cents = F.col("quantity").cast("long") * (F.col("unit_price").cast(MONEY) * 100).cast("long")
    made = items.groupBy("product_id").agg(F.sum(F.col("quantity").cast("long")).alias("units"), F.sum(cents).alias("revenue_cents"))
    return made.orderBy(F.col("revenue_cents").desc(), F.col("product_id").asc_nulls_first()).limit(n)


def by_customer(customers: DataFrame, n: int = 10) -> DataFrame:
    got = customers.select("customer_id", "country", F.col("lifetime_orders").alias("orders"), "lifetime_value")
    return got.orderBy(F.col("lifetime_value").desc(), "customer_id").limit(n)


def inventory_counts(health: DataFrame) -> DataFrame:
    return health.agg(*(F.count_if(F.col("inventory_status") == s).alias(s) for s in ("healthy", "stale", "unknown")))


def inventory_top(health: DataFrame, n: int = 10) -> DataFrame:
    rank = F.when(F.col("inventory_status") == "healthy", 0).when(F.col("inventory_status") == "stale", 1).otherwise(2)
    return health.orderBy(rank, F.col("last_inventory_update").desc_nulls_last(), "product_id").limit(n)


def per_minute(events: DataFrame, column: str = "ingestion_timestamp") -> DataFrame:
    return events.groupBy(F.date_trunc("minute", column).cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("events"))


def latency(frame: DataFrame, sent: str, arrived: str) -> DataFrame:
    """Average and greatest milliseconds between two times."""
    ms = F.unix_millis(F.col(arrived).cast("timestamp")) - F.unix_millis(F.col(sent).cast("timestamp"))
    return frame.agg(F.try_divide(F.sum(ms).cast("double"), F.count(ms)).alias("average_latency_ms"), F.max(ms).alias("maximum_latency_ms"))


def run_rates(runs: DataFrame) -> DataFrame:
    """Shares of duplicates, rejections and late records of each run; a run that read nothing has zeros."""
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("records_read").cast("double")), F.lit(0.0))
    return runs.select(
        "*", share("records_duplicate").alias("duplicate_rate"), share("records_rejected").alias("rejection_rate"), share("records_late").alias("late_event_rate")
    )


#: metric, threshold, severity: an alert needs a value strictly above.
THRESHOLDS = (("pipeline_failure", 0.0, "critical"), ("duplicate_rate", 0.05, "warning"), ("rejection_rate", 0.02, "warning"), ("late_event_rate", 0.05, "warning"))


def alerts(rates: DataFrame, key: str = "run_id") -> DataFrame:
    rows = F.array(
        *(
            F.struct(
                F.lit(metric).alias("metric"),
                (F.when(F.col("status") == "SUCCESS", 0.0).otherwise(1.0) if metric == "pipeline_failure" else F.col(metric)).alias("value"),
                F.lit(limit).alias("threshold"),
                F.lit(severity).alias("severity"),
            )
            for metric, limit, severity in THRESHOLDS
        )
    )
    return rates.select(key, F.explode(rows).alias("a")).select(key, "a.*").where(F.col("value") > F.col("threshold"))


def reconcile(pairs: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row with one exact total per name, each a scalar subquery over its own table."""
    spark = next(iter(pairs.values()))[0].sparkSession
    return spark.range(1).select(*(frame.agg(value.alias(name)).scalar().alias(name) for name, (frame, value) in pairs.items()))


def column_tests(frame: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = (), accepted: dict[str, Sequence] | None = None, positive: Sequence[str] = ()) -> DataFrame:
    """Failures per test in one pass over the table, plus one aggregation per uniqueness test."""
    accepted = accepted or {}
    single = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in not_null}
    single |= {f"accepted:{c}": F.count_if(~F.col(c).isin(*v)) for c, v in accepted.items()}
    single |= {f"positive:{c}": F.count_if(F.col(c) <= 0) for c in positive}
    out = None
    if single:
        one = frame.agg(*(v.alias(f"t{i}") for i, v in enumerate(single.values())))
        rows = F.array(*(F.struct(F.lit(n).alias("test"), F.col(f"t{i}").alias("failures")) for i, n in enumerate(single)))
        out = one.select(F.explode(rows).alias("r")).select("r.*")
    for c in unique:
        again = frame.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        part = again.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(f"unique:{c}").alias("test"), "failures")
        out = part if out is None else out.unionByName(part)
    return out


def relationship(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of the child whose reference names no parent at all; null references are ignored."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__parent")).distinct(), F.col(column) == F.col("__parent"), "left_anti")


def readiness(tables: dict[str, DataFrame], orphans: DataFrame) -> DataFrame:
    """One row: rows per table, orphan references, and whether every table has rows and no reference is an orphan."""
    n = F.count(F.lit(1))
    row = reconcile({**{name: (frame, n) for name, frame in tables.items()}, "orphans": (orphans, n)})
    ready = F.col("orphans") == 0
    for name in tables:
        ready = ready & (F.col(name) > 0)
    return row.withColumn("ready", ready)
