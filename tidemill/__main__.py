"""Command line: python -m tidemill init|produce|process|gold|status|export|reset --root FOLDER."""

from __future__ import annotations

import argparse
import datetime
import os
import shutil

from pyspark.sql import functions as F

from tidemill.operators import ops
from tidemill.plans import gold, kpi
from tidemill.session import local_session, materialize
from tidemill.sources import generator, landing, tail
from tidemill.streaming import bronze_silver


def _raw(spark, inbox: str):
    tail.register(spark)
    lines = spark.readStream.format("jsonl_tail").option("path", inbox).option("verify", "true").load()
    return lines.select(
        "raw_payload", "topic", "kafka_partition", "kafka_offset", "kafka_timestamp", F.current_timestamp().cast("timestamp_ntz").alias("ingestion_timestamp"),
        F.lit(None).cast("string").alias("scenario"), F.lit("local").alias("stream_run_id"),
    )


def produce(spark, root: str, count: int, scenario: str, seed: int) -> int:
    """Append generated events to the inbox, one file per topic."""
    os.makedirs(f"{root}/inbox", exist_ok=True)
    made = generator.events(spark, count, scenario, seed, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))
    n = 0
    files: dict[str, object] = {}
    try:
        for row in made.orderBy("n").toLocalIterator():
            if row.topic not in files:
                files[row.topic] = open(f"{root}/inbox/{row.topic}.jsonl", "a", encoding="utf-8")  # noqa: SIM115
            files[row.topic].write(row.raw_payload + "\n")
            n += 1
    finally:
        for f in files.values():
            f.close()
    return n


def process(spark, root: str) -> dict:
    """Inbox to Bronze, Silver and quarantine, with a ledger row; returns the counts."""
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    run_id = f"run-{now:%Y%m%dT%H%M%S%f}"
    ledger, house = ops.Ledger(spark, f"file://{root}/ledger"), bronze_silver.Lakehouse(spark, f"file://{root}/lake")
    ledger.start(run_id, "process", now)
    try:
        before = set() if not house.audit.exists() else {(r.checkpoint_namespace, r.batch_id) for r in house.audit.read().select("checkpoint_namespace", "batch_id").collect()}
        bronze_silver.run(_raw(spark, f"{root}/inbox"), house, f"file://{root}/checkpoints")
        counts = dict.fromkeys(ops.COUNTS, 0)
        if house.audit.exists():
            for r in house.audit.read().collect():
                if (r.checkpoint_namespace, r.batch_id) not in before:
                    counts = {c: counts[c] + r[c] for c in counts}
        ledger.move(run_id, ops.COMMITTED, now, **counts)
        ledger.move(run_id, ops.SUCCESS, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), **counts)
    except Exception as e:
        ledger.move(run_id, ops.FAILED, now, str(e))
        raise
    ended = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    run = {"run_id": run_id, "status": ops.SUCCESS, "duration_seconds": (ended - now).total_seconds(), **counts}
    found = [r.asDict() for r in kpi.alerts(kpi.run_rates(ledger.read().where(F.col("run_id") == run_id))).collect()]
    ops.publish(root, run, found)
    return run


def build_gold(spark, root: str) -> str:
    """Facts and marts from Silver; a failing cast leaves the earlier ones as they were. Returns the snapshot."""
    from tidemill.sources.versioned import VersionedTable

    silver = bronze_silver.Lakehouse(spark, f"file://{root}/lake").silver.read()
    stg = gold.stg_events(silver)
    items = gold.fact_order_items_from_events(stg)
    orders = gold.fact_orders_from_events(stg)
    sales = gold.daily_sales(orders)
    marts = {"fact_order_items": items, "fact_orders": orders, "daily_sales": sales, "dim_customer": gold.dim_customer_from_events(stg)}
    # all are computed and checked before the first commit: a failed build leaves the earlier marts as they were
    marts = {name: materialize(frame) for name, frame in marts.items()}
    items, orders, sales, customers = (marts[n] for n in ("fact_order_items", "fact_orders", "daily_sales", "dim_customer"))
    n, money = F.count(F.lit(1)), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(gold.TOTAL)
    bought = gold.purchases(stg)
    totals = kpi.reconcile(
        {
            "silver_items": (bought, n), "gold_items": (items, n), "silver_orders": (bought.select("order_id").distinct(), n), "gold_orders": (orders, n),
            "silver_revenue": (bought, money("line_total")), "gold_revenue": (orders, money("order_total")), "daily_revenue": (sales, money("revenue")),
        }
    ).first().asDict()
    ops.reconcile_or_fail(totals, [("silver_items", "gold_items"), ("silver_orders", "gold_orders"), ("silver_revenue", "gold_revenue"), ("gold_revenue", "daily_revenue")])
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)
    health = gold.inventory_health(stg, F.lit(now).cast("timestamp_ntz"))
    document = ops.snapshot(
        kpi.summary(orders), sales, kpi.by_country(orders), kpi.by_product(items), kpi.by_customer(gold.customer_360(customers, orders)), kpi.inventory_top(health),
        kpi.per_minute(silver).orderBy(F.col("minute").desc()).limit(60), totals, {"generated_at": now.isoformat(), "tables": sorted(marts)},
    )
    if wrong := ops.validate_snapshot(document):
        raise ops.Unreconciled("; ".join(wrong))
    for name, frame in marts.items():
        VersionedTable(spark, f"file://{root}/gold/{name}").overwrite(frame)
    ops.write_atomic(f"{root}/snapshot.json", document)
    return document


def reset(root: str) -> None:
    """Delete a folder that this program made; anything else is refused."""
    there = set(os.listdir(root)) if os.path.isdir(root) else set()
    known = {"inbox", "lake", "ledger", "checkpoints", "gold", "metrics.prom", "incident.txt", "latest.json", "alerts.jsonl", "snapshot.json", "export"}
    if os.path.abspath(root) in ("/", os.path.expanduser("~")) or there - known:
        raise ValueError(f"{root} is not a folder of this program")
    shutil.rmtree(root, ignore_errors=True)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("tidemill")
    parser.add_argument("verb", choices=("init", "produce", "process", "gold", "status", "export", "reset"))
    parser.add_argument("--root", required=True)
    parser.add_argument("--count", type=int, default=100)
    parser.add_argument("--scenario", choices=generator.SCENARIOS, default="normal")
    parser.add_argument("--seed", type=int, default=42)
    args = parser.parse_args(argv)
    root = os.path.abspath(args.root)
    if args.verb == "reset":
        return reset(root)
    spark = local_session()
    if args.verb == "init":
        os.makedirs(f"{root}/inbox", exist_ok=True)
        ops.Ledger(spark, f"file://{root}/ledger")
    elif args.verb == "produce":
        print(produce(spark, root, args.count, args.scenario, args.seed))
    elif args.verb == "process":
        print(process(spark, root))
    elif args.verb == "gold":
        print(build_gold(spark, root))
    elif args.verb == "status":
        ops.Ledger(spark, f"file://{root}/ledger").read().orderBy(F.col("started_at").desc()).limit(20).show(truncate=False)
    else:
        house = bronze_silver.Lakehouse(spark, f"file://{root}/lake")
        landing.export_ordered(house.silver.read(), f"file://{root}/export/silver", ["event_id"])
        landing.export_ordered(house.bronze.read(), f"file://{root}/export/bronze", ["topic", "kafka_partition", "kafka_offset"])
        for name, table, order in (("quarantine", house.quarantine, ["topic", "kafka_partition", "kafka_offset"]), ("audit", house.audit, ["checkpoint_namespace", "batch_id"])):
            if table.exists():
                landing.export_ordered(table.read(), f"file://{root}/export/{name}", order)


if __name__ == "__main__":
    main()
