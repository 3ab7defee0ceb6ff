"""Micro-batches of raw messages into Bronze, Silver, quarantine and an audit row per batch.

A batch is classified once and written by key, so replaying it after a crash inserts nothing twice: Bronze and
quarantine by transport coordinates, Silver by event_id, the audit by (namespace, batch). The audit comes last.
Lateness is a rule of the contract, not a watermark: late messages are kept in quarantine.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import contract
from tidemill.operators.dedup import dedupe_rows
from tidemill.session import materialize, prepare
from tidemill.sources.versioned import VersionedTable

TRANSPORT = ["stream_run_id", "topic", "kafka_partition", "kafka_offset"]
AUDIT = (
    "checkpoint_namespace string, batch_id long, records_read long, records_written long, records_rejected long, records_late long, records_duplicate long, "
    "duration_seconds double, average_latency_ms double, maximum_latency_ms long, completed_at timestamp"
)


@dataclass
class Lakehouse:
    """The four tables below one folder."""

    spark: SparkSession
    root: str

    def __post_init__(self):
        at = lambda n: VersionedTable(self.spark, f"{self.root}/{n}")
        self.bronze, self.silver, self.quarantine, self.audit = at("bronze"), at("silver"), at("quarantine"), at("audit")


def process_batch(house: Lakehouse, batch: DataFrame, batch_id: int, namespace: str, price_type: str | None = None, fail_after_silver: Callable[[int], None] | None = None, partitions: int | None = None) -> dict:
    """One micro-batch. Counts: read = written + duplicate + rejected + late, on a first run as on a replay.

    ``partitions`` deals the batch out to more tasks than its source has, as a topic of few partitions needs.
    """
    began = time.time()
    spark = batch.sparkSession
    if partitions:
        batch = batch.repartition(partitions)
    # the frame of a foreachBatch call belongs to this batch alone; written out, it is classified once
    classified = materialize(contract.classify(batch, price_type=price_type))
    late = F.col("error_type") == contract.LATE_EVENT
    ms = F.unix_millis(F.col("ingestion_timestamp").cast("timestamp")) - F.unix_millis(F.col("event_timestamp").cast("timestamp"))
    ok = F.col("error_type").isNull()
    counts = classified.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(ok).alias("accepted"),
        F.count_if(late).alias("late"),
        F.try_divide(F.sum(F.when(ok, ms)).cast("double"), F.count_if(ok)).alias("average"),
        F.max(F.when(ok, ms)).alias("most"),
        F.min("kafka_offset").alias("first_offset"),
        F.max("kafka_offset").alias("last_offset"),
    ).first()
    if not counts["read"]:
        return {"read": 0}
    # a replay can only meet rows of these offsets: file statistics rule out the rest of the tables
    near = F.col("kafka_offset").between(counts["first_offset"], counts["last_offset"])
    rejected = classified.where(~ok).select("event_id", *batch.columns, "error_type", "error_message")
    accepted = classified.where(ok).drop("error_type", "error_message", "raw_payload")
    first = dedupe_rows(accepted, ["event_id"], [F.col(c) for c in ("topic", "kafka_partition", "kafka_offset")])
    # three tables, each written by key: their jobs may run at the same time
    with ThreadPoolExecutor(3) as pool:
        merges = [
            pool.submit(house.bronze.merge_insert_only, classified.select(*batch.columns), TRANSPORT, near),
            pool.submit(house.quarantine.merge_insert_only, rejected, TRANSPORT, near),
            pool.submit(house.silver.merge_insert_only, first, ["event_id"]),
        ]
    written = [m.result() for m in merges][2]["inserted"]
    if fail_after_silver is not None:
        fail_after_silver(batch_id)
    row = {
        "read": counts["read"], "written": written, "rejected": counts["read"] - counts["accepted"] - counts["late"], "late": counts["late"],
        "duplicate": counts["accepted"] - written,
    }
    values = (namespace, batch_id, row["read"], row["written"], row["rejected"], row["late"], row["duplicate"], time.time() - began, counts["average"], counts["most"])
    audit = spark.createDataFrame([values], AUDIT.rsplit(",", 1)[0]).withColumn("completed_at", F.current_timestamp())
    mine = (F.col("checkpoint_namespace") == namespace) & (F.col("batch_id") == batch_id)
    if house.audit.exists() and house.audit.read().where(mine).limit(1).count():
        house.audit.merge_upsert(audit, ["checkpoint_namespace", "batch_id"])
    else:
        house.audit.append(audit)
    return row


def run(
    source: DataFrame, house: Lakehouse, checkpoint: str, namespace: str = "main", seconds: float | None = None, every: str | None = None, price_type: str | None = None,
    fail_after_silver: Callable[[int], None] | None = None, partitions: int | None = None,
) -> list[dict]:
    """Run a stream until its input is used up (or every ``every`` seconds until ``seconds`` are over).

    The checkpoint lies below the namespace: a changed plan takes a new namespace. Returns the progress of the batches.
    """
    prepare(source.sparkSession)
    writer = source.writeStream.option("checkpointLocation", f"{checkpoint}/{namespace}").foreachBatch(
        lambda frame, batch_id: process_batch(house, frame, batch_id, namespace, price_type, fail_after_silver, partitions) and None
    )
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    ended = query.awaitTermination(seconds) if seconds else query.awaitTermination() or True
    if not ended:
        query.stop()
        if not every:
            raise TimeoutError(f"stream {namespace} did not end within {seconds} seconds")
    return [json.loads(p.json) for p in query.recentProgress]


def periods(events: DataFrame, event: str, width: str = "1 day", lateness: str = "48 hours") -> DataFrame:
    """A streaming tumbling aggregate: count and sum of ``units`` per period, final once the watermark has passed it."""
    return (
        events.withWatermark(event, lateness)
        .groupBy(F.window(event, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("quantity").cast("long")).alias("units"))
        .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "events", "units")
    )
