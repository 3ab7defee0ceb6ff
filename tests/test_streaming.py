import json
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tests.test_contract import raw
from tidemill.sources import stream, tail
from tidemill.streaming import bronze_silver

T = D(2026, 10, 4, 6, 40)
ID2 = "6021dc2f-001f-4627-a4be-0b543624c792"


def write(spark, path, rows, first=0):
    full = [(p, "order-events", 0, first + i, T, T, "normal", "run") for i, p in enumerate(rows)]
    spark.createDataFrame(full, stream.RAW).coalesce(1).write.mode("append").parquet(path)


def audit(house):
    rows = house.audit.read().orderBy("checkpoint_namespace", "batch_id").collect()
    return [(r.records_read, r.records_written, r.records_duplicate, r.records_rejected, r.records_late) for r in rows]


def test_crash_after_silver_then_replay_then_next_batch(spark, tmp_path):
    src, house = str(tmp_path / "in"), bronze_silver.Lakehouse(spark, f"file://{tmp_path}/lake")
    write(spark, src, [raw(), raw(), raw(event_id="bad"), raw(event_id=ID2, event_timestamp="2026-10-04T00:00:00Z")])

    def crash(_):
        raise RuntimeError("stop here")

    go = lambda **k: bronze_silver.run(stream.parquet_files(spark, src), house, f"file://{tmp_path}/ck", **k)
    with pytest.raises(Exception, match="stop here"):
        go(fail_after_silver=crash)
    assert house.silver.read().count() == 1 and not house.audit.exists()
    go()
    assert audit(house) == [(4, 0, 2, 1, 1)]  # the crashed attempt had written the row already
    write(spark, src, [raw(event_id=ID2), raw()], first=4)
    go()
    assert audit(house) == [(4, 0, 2, 1, 1), (2, 1, 1, 0, 0)]
    assert (house.bronze.read().count(), house.silver.read().count(), house.quarantine.read().count()) == (6, 2, 2)
    assert go() == [] or audit(house)[-1] == (2, 1, 1, 0, 0)
    kinds = {r.error_type: r.raw_payload for r in house.quarantine.read().collect()}
    assert set(kinds) == {"SCHEMA_VALIDATION", "LATE_EVENT"} and all(kinds.values())


def test_header_lookup(spark):
    h = F.array(F.struct(F.lit("a").alias("key"), F.encode(F.lit("1"), "UTF-8").alias("value")))
    row = spark.range(1).select(h.alias("h")).select(stream.header("h", "a").alias("a"), stream.header("h", "b").alias("b")).first()
    assert (row.a, row.b) == ("1", None)


def drain(spark, folder, ck, out, **options):
    tail.register(spark)
    reader = spark.readStream.format("jsonl_tail").option("path", str(folder))
    for k, v in options.items():
        reader = reader.option(k, v)
    query = reader.load().writeStream.format("parquet").option("checkpointLocation", str(ck)).trigger(availableNow=True).start(str(out))
    query.awaitTermination()
    return sorted((r.topic, r.raw_payload) for r in spark.read.parquet(str(out)).collect())


def test_tail_reads_appended_lines_once_and_detects_tampering(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    a = inbox / "order-events.jsonl"
    a.write_text('{"n":1}\n\n{"n":2}\n{"half')
    got = drain(spark, inbox, tmp_path / "ck", tmp_path / "out", verify="true", split_bytes="5")
    assert got == [("order-events", '{"n":1}'), ("order-events", '{"n":2}')]
    a.write_text(a.read_text() + '":3}\n')
    (inbox / "customer-events.jsonl").write_text('{"c":1}\n')
    got = drain(spark, inbox, tmp_path / "ck", tmp_path / "out", verify="true", split_bytes="5")
    assert [json.loads(p) for _, p in got] == [{"c": 1}, {"half": 3}, {"n": 1}, {"n": 2}]
    a.write_text(a.read_text().replace('"n":1', '"n":9'))
    with pytest.raises(Exception, match="changed"):
        drain(spark, inbox, tmp_path / "ck", tmp_path / "out", verify="true")
    a.write_text("")
    with pytest.raises(Exception, match="shorter"):
        drain(spark, inbox, tmp_path / "ck", tmp_path / "out")


def test_tumbling_periods(spark, tmp_path):
    rows = [(D(2026, 1, 1, 3), 2), (D(2026, 1, 1, 5), None), (D(2026, 1, 9), 1)]
    spark.createDataFrame(rows, "e timestamp, quantity int").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("e timestamp, quantity int").parquet(str(tmp_path / "e"))
    q = bronze_silver.periods(events, "e").writeStream.format("memory").queryName("periods").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.events, r.units) for r in spark.table("periods").collect()] == [(2, 2)]
