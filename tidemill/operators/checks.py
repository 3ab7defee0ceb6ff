"""Declarative data tests, verifiers of runs and deliveries, and the latest success of each stage.

Defined results: null values fail not_null only; a value that occurs several times is one failure of unique; a null
reference is no failure of a relationship; a missing scenario counts as zero; an empty table has no failures.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.contract import TOPIC_OF
from tidemill.plans import kpi


@dataclass(frozen=True)
class Check:
    """One test: unique, not_null, accepted (values), relationship (to a table and its key), or rows that must not be (failing, SQL)."""

    table: str
    kind: str
    column: str = ""
    values: tuple = ()
    to: tuple[str, str] = ("", "")
    failing: str = ""

    @property
    def name(self) -> str:
        return f"{self.table}.{self.kind}:{self.failing if self.kind == 'rows' else self.column}"


def _key(table: str, column: str) -> tuple[Check, Check]:
    return Check(table, "unique", column), Check(table, "not_null", column)


# The tests that the marts must pass.
GOLD = (
    *_key("stg_events", "event_id"), Check("stg_events", "not_null", "event_type"), Check("stg_events", "accepted", "event_type", tuple(TOPIC_OF)),
    *_key("dim_customer", "customer_id"), *_key("dim_product", "product_id"), Check("dim_product", "not_null", "average_price"), *_key("dim_date", "date_key"),
    *_key("fact_orders", "order_id"), Check("fact_orders", "relationship", "customer_id", to=("dim_customer", "customer_id")), Check("fact_orders", "not_null", "order_total"),
    *_key("fact_order_items", "order_item_id"), Check("fact_order_items", "relationship", "product_id", to=("dim_product", "product_id")),
    Check("fact_order_items", "relationship", "order_id", to=("fact_orders", "order_id")), Check("fact_order_items", "not_null", "quantity"), Check("fact_order_items", "not_null", "unit_price"),
    *_key("daily_sales", "order_date"),
    Check("fact_orders", "rows", failing="order_total < 0"), Check("fact_order_items", "rows", failing="unit_price < 0"), Check("fact_order_items", "rows", failing="quantity <= 0"),
)


def run(tables: Mapping[str, DataFrame], checks: Iterable[Check] = GOLD) -> DataFrame:
    """check, failures. All tests of single rows of a table are one pass over it."""
    checks = list(checks)
    parts = []
    for name in dict.fromkeys(c.table for c in checks):
        mine, frame = [c for c in checks if c.table == name], tables[name]
        bad: dict[str, Column] = {c.name: F.col(c.column).isNull() for c in mine if c.kind == "not_null"}
        bad |= {c.name: ~F.col(c.column).isin(*c.values) for c in mine if c.kind == "accepted"}
        bad |= {c.name: F.expr(c.failing) for c in mine if c.kind == "rows"}
        if bad:
            one = frame.agg(*(F.count_if(v).alias(f"t{i}") for i, v in enumerate(bad.values())))
            rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"t{i}").alias("failures")) for i, n in enumerate(bad)))
            parts.append(one.select(F.explode(rows).alias("r")).select("r.*"))
        for c in mine:
            failing = None
            if c.kind == "unique":
                failing = frame.where(F.col(c.column).isNotNull()).groupBy(c.column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            elif c.kind == "relationship":
                failing = kpi.relationship(frame, c.column, tables[c.to[0]], c.to[1])
            if failing is not None:
                parts.append(failing.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(c.name).alias("check"), "failures"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verify_scenarios(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """scenario, expected, records, ok: counts (scenario, records) of a run against what each scenario should leave."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), "scenario string, expected long")
    joined = wanted.join(counts.select(F.col("scenario").alias("__s"), "records"), F.col("scenario") == F.col("__s"), "full")
    got = joined.select(F.coalesce("scenario", "__s").alias("scenario"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("records", F.lit(0)).alias("records"))
    return got.withColumn("ok", F.col("expected") == F.col("records"))


def transport_nulls(raw: DataFrame) -> DataFrame:
    """Rows of raw messages by whether any of their five transport columns is null: read, incomplete."""
    columns = ("topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "stream_run_id")
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    return raw.agg(F.count(F.lit(1)).alias("read"), F.count_if(any_null).alias("incomplete"))


def compare_deliveries(first: Mapping[str, Mapping[str, int]], second: Mapping[str, Mapping[str, int]], more: Mapping[str, int]) -> list[str]:
    """What is wrong with a second delivery of the same data: per dataset, valid and silver must stay, rejected may grow by ``more``."""
    wrong = []
    for name in sorted({*first, *second}):
        a, b = first.get(name, {}), second.get(name, {})
        wrong += [f"{name}.{c}: {a.get(c)} became {b.get(c)}" for c in ("valid", "silver") if a.get(c) != b.get(c)]
        if b.get("rejected", 0) - a.get("rejected", 0) != more.get(name, 0):
            wrong.append(f"{name}.rejected: {a.get('rejected', 0)} became {b.get('rejected', 0)}, {more.get(name, 0)} more expected")
    return wrong


def accept_replay(first: Mapping[str, int], replay: Mapping[str, int]) -> list[str]:
    """What is wrong with a replay: it reads the same, writes nothing and counts what was accepted as duplicates."""
    wrong = [f"replay read {replay['records_read']} of {first['records_read']}"] if replay["records_read"] != first["records_read"] else []
    if replay["records_written"]:
        wrong.append(f"replay wrote {replay['records_written']} records")
    if replay["records_duplicate"] != first["records_written"] + first["records_duplicate"]:
        wrong.append(f"replay found {replay['records_duplicate']} duplicates")
    return wrong


def accept_history(versions: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Keys by their history: versions, open_versions, and ok (at least ``least`` versions, exactly one of them open)."""
    made = versions.groupBy(key).agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("valid_to").isNull()).alias("open_versions"))
    return made.withColumn("ok", (F.col("versions") >= least) & (F.col("open_versions") == 1))


def latest_success(stages: Mapping[str, DataFrame]) -> DataFrame:
    """stage, latest_success: newest completed_at of a run with status SUCCESS per stage (null if none), and of all as 'any'."""
    made = None
    for name, runs in stages.items():
        part = runs.agg(F.max(F.when(F.col("status") == "SUCCESS", F.col("completed_at"))).alias("latest_success")).select(F.lit(name).alias("stage"), "latest_success")
        made = part if made is None else made.unionByName(part)
    return made.unionByName(made.agg(F.max("latest_success").alias("latest_success")).select(F.lit("any").alias("stage"), "latest_success"))
