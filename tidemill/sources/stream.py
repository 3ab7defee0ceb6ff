"""Streaming sources with one shape: raw_payload, topic, kafka_partition, kafka_offset, kafka_timestamp, scenario, stream_run_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = (
    "raw_payload string, topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz, scenario string, stream_run_id string"
)


def header(headers: str | Column, name: str) -> Column:
    """The text of a message header by name, null if there is none: get() doesn't fail on an empty list, element_at does."""
    column = F.col(headers) if isinstance(headers, str) else headers
    return F.decode(F.get(F.filter(column, lambda h: h["key"] == name), F.lit(0))["value"], "UTF-8")


def kafka(spark: SparkSession, servers: str, topics: Sequence[str], run_id: str | None = None, most_per_trigger: int = 5000, secure: dict[str, str] | None = None) -> DataFrame:
    """Kafka topics from their earliest offsets. Needs the Kafka connector on the class path; ``secure`` adds its options."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", most_per_trigger)
        .option("failOnDataLoss", "true")
        .option("includeHeaders", "true")
    )
    for key, value in (secure or {}).items():
        reader = reader.option(f"kafka.{key}", value)
    raw = reader.load().select(
        F.col("value").cast("string").alias("raw_payload"), "topic", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"),
        F.col("timestamp").cast("timestamp_ntz").alias("kafka_timestamp"), F.current_timestamp().cast("timestamp_ntz").alias("ingestion_timestamp"),
        header("headers", "scenario").alias("scenario"), header("headers", "stream_run_id").alias("stream_run_id"),
    )
    return raw if run_id is None else raw.where(F.col("stream_run_id") == run_id)


def parquet_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of raw messages as a stream, under an explicit schema. ``path`` is a folder or a single file."""
    # as a pattern, a single file is accepted too
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def kafka_send(frame: DataFrame, servers: str, run_id: str, secure: dict[str, str] | None = None) -> None:
    """raw_payload rows to their topics, with scenario and run as headers. Needs the Kafka connector on the class path."""
    text = lambda c: F.encode(c, "UTF-8")
    named = [(n, c) for n, c in (("scenario", F.col("scenario") if "scenario" in frame.columns else None), ("stream_run_id", F.lit(run_id))) if c is not None]
    headers = F.array(*(F.struct(F.lit(n).alias("key"), text(c).alias("value")) for n, c in named))
    writer = frame.select("topic", text(F.col("raw_payload")).alias("value"), headers.alias("headers")).write.format("kafka").option("kafka.bootstrap.servers", servers)
    for key, value in {"enable.idempotence": "true", "acks": "all", **(secure or {})}.items():
        writer = writer.option(f"kafka.{key}", value)
    writer.option("includeHeaders", "true").save()
