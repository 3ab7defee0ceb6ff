import json
import zipfile
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

import tidemill.__main__ as cli
from tidemill.functions import contract
from tidemill.operators import ops, quality
from tidemill.operators.parse import INVOICE_FIELDS
from tidemill.sources import generator, landing

T = D(2026, 1, 1)


@pytest.mark.parametrize(("scenario", "sent", "bad", "late"), [("normal", 120, 0, 0), ("duplicate", 160, 0, 0), ("malformed", 120, 30, 0), ("late-data", 120, 0, 40), ("traffic-spike", 1200, 0, 0)])
def test_generator(spark, scenario, sent, bad, late):
    made = generator.events(spark, 120, scenario, now=T)
    assert made.count() == sent and made.repartition(3).exceptAll(generator.events(spark, 120, scenario, now=T)).count() == 0
    kinds = {r.error_type: r.n for r in contract.classify(made.withColumn("ingestion_timestamp", F.lit(T))).groupBy("error_type").agg(F.count("*").alias("n")).collect()}
    assert kinds.get("SCHEMA_VALIDATION", 0) == bad and kinds.get("LATE_EVENT", 0) == late and kinds[None] == sent - bad - late
    with pytest.raises(ValueError):
        generator.events(spark, 200_000)
    with pytest.raises(ValueError):
        generator.events(spark, 1, "nonsense")


def test_end_to_end(spark, tmp_path):
    root = str(tmp_path / "root")
    assert cli.produce(spark, root, 60, "duplicate", 1) == 80
    run = cli.process(spark, root)
    assert ops.balanced(run) and (run["records_read"], run["records_written"], run["records_duplicate"]) == (80, 60, 20)
    again = cli.process(spark, root)
    assert again["records_read"] == 0
    cli.produce(spark, root, 20, "malformed", 2)
    run = cli.process(spark, root)
    assert (run["records_read"], run["records_written"], run["records_rejected"]) == (20, 15, 5)
    document = json.loads(cli.build_gold(spark, root))
    assert document["kpis"]["orders"] == sum(d["orders"] for d in document["dailySales"]) and "rejection_rate" in (tmp_path / "root/incident.txt").read_text()
    prom = (tmp_path / "root/metrics.prom").read_text()
    assert 'records_total{status="rejected"} 5' in prom and "tidemill_pipeline_failed 0" in prom and "tidemill_alerts 1" in prom and "duration_seconds" in prom
    latest = json.loads((tmp_path / "root/latest.json").read_text())
    assert latest["run"]["records_read"] == 20 and [a["metric"] for a in latest["alerts"]] == ["rejection_rate"]
    # the duplicates of the first run and the rejections of the last
    assert [json.loads(x)["metric"] for x in (tmp_path / "root/alerts.jsonl").read_text().splitlines()] == ["duplicate_rate", "rejection_rate"]
    assert "action: look at the quarantine" in (tmp_path / "root/incident.txt").read_text()
    assert {"customers", "inventory", "eventRate", "reconciliation", "metadata"} <= document.keys() and document["reconciliation"]["gold_revenue"] == document["reconciliation"]["daily_revenue"]
    cli.main(["export", "--root", root])
    lines = [json.loads(x) for f in (tmp_path / "root/export/quarantine").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 5 and list((tmp_path / "root/export/audit").glob("part-*"))
    states = [r.status for r in ops.Ledger(spark, f"file://{root}/ledger").read().collect()]
    assert states == ["SUCCESS"] * 3
    (tmp_path / "root" / "mine.txt").write_text("x")
    with pytest.raises(ValueError):
        cli.reset(root)
    (tmp_path / "root" / "mine.txt").unlink()
    cli.reset(root)
    assert not (tmp_path / "root").exists()


def test_ledger_states(spark, tmp_path):
    book = ops.Ledger(spark, f"file://{tmp_path}/l")
    book.start("a", "p", T)
    book.start("b", "p", T)
    book.move("b", ops.COMMITTED, T, records_read=3)
    with pytest.raises(ValueError):
        book.move("b", ops.RUNNING)
    with pytest.raises(ValueError):
        book.move("zzz", ops.SUCCESS)
    book.start("c", "p", T)
    book.move("c", ops.FAILED, T, "why")
    got = {r.run_id: (r.status, r.records_read, r.message) for r in book.read().collect()}
    assert got == {"a": ("INTERRUPTED", 0, None), "b": ("RECOVERED", 3, None), "c": ("FAILED", 0, "why")}


@pytest.mark.parametrize("value", [None, float("nan"), float("inf"), -1, True, "2"])
def test_reconciliation_fails_closed(value):
    ops.reconcile_or_fail({"a": 1, "b": 1.0}, [("a", "b")])
    with pytest.raises(ops.Unreconciled):
        ops.reconcile_or_fail({"a": value, "b": 1}, [("a", "b")])
    with pytest.raises(ops.Unreconciled):
        ops.reconcile_or_fail({"a": 2, "b": 1}, [("a", "b")])


def test_snapshot_checks():
    day = {"order_date": "2026-01-01", "orders": 1, "units": 2, "revenue": 3.0}
    good = {"kpis": {"orders": 1, "units": 2, "revenue": 3.0, "average_order_value": 3.0}, "dailySales": [day], "countries": [], "products": []}
    assert ops.validate_snapshot(json.dumps(good)) == []
    assert len(ops.validate_snapshot(json.dumps(good | {"dailySales": [day, day]}))) == 4
    assert ops.validate_snapshot(json.dumps({"kpis": {}, "x": 1})) == ["missing countries", "missing dailySales", "missing products", "unknown x"]


def test_profiles():
    assert ops.Profile.parse({"name": "dev", "events": 10, "batch_size": 5}).events == 10
    for bad in ({"name": "Dev", "events": 1}, {"name": "dev", "events": 0}, {"name": "dev", "events": True}, {"name": "dev", "events": 1, "batch_size": 2}):
        with pytest.raises(ValueError):
            ops.Profile.parse(bad)


def sheet(rows):
    cell = lambda c, v: f'<c r="{c}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join("<row>" + "".join(cell(f"{chr(65 + i)}{n}", v) for i, v in enumerate(r) if v is not None) + "</row>" for n, r in enumerate(rows, 1))
    return f'<worksheet xmlns="x"><sheetData>{body}</sheetData></worksheet>'


def archive(path, rows, name="book.xlsx"):
    import io

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, inner.getvalue())


def test_archive_to_entities(spark, tmp_path):
    rows = [INVOICE_FIELDS, ("1", "A", "x", "2", "2010-12-01 08:26:00", "1.5", None, "X"), ("C2", "A", "y", "-1", "2010-12-02 08:26:00", "2", "7", "Y")]
    archive(tmp_path / "a.zip", rows)
    found = landing.archives(spark, str(tmp_path))
    lines = landing.invoice_lines(found, sha256=found.first().sha256)
    made = quality.normalize_invoices(lines, "row_number")
    assert made["order_items"].count() == 2 and [r.description for r in made["products"].collect()] == ["y"]
    delivery = landing.Delivery(spark, f"file://{tmp_path}/out")
    assert delivery.write(made) == {"customers": 1, "products": 1, "orders": 2, "order_items": 2} == landing.Delivery(spark, f"file://{tmp_path}/out").write(made)
    made["orders"].write.json(f"file://{tmp_path}/part/orders")
    with pytest.raises(FileExistsError):
        landing.Delivery(spark, f"file://{tmp_path}/part").write(made)
    with pytest.raises(Exception, match="hash is"):
        landing.invoice_lines(found, sha256="0").count()
    archive(tmp_path / "a.zip", [("x", "y")])
    with pytest.raises(Exception, match="columns are"):
        landing.invoice_lines(landing.archives(spark, str(tmp_path))).count()


def test_archive_outside_size_gate_is_rejected(spark, tmp_path):
    archive(tmp_path / "a.zip", [INVOICE_FIELDS, ("1", "A", "x", "2", "2010-12-01 08:26:00", "1.5", None, "X")])
    size = (tmp_path / "a.zip").stat().st_size
    assert landing.invoice_lines(landing.archives(spark, str(tmp_path), size)).count() == 1
    (tmp_path / "a.zip").rename(tmp_path / "a b%20.zip")
    assert landing.archives(spark, str(tmp_path)).count() == 1
    (tmp_path / "a b%20.zip").rename(tmp_path / "a.zip")
    with pytest.raises(landing.RejectedArchive, match=f"a.zip: size is {size}"):
        landing.archives(spark, str(tmp_path), size - 1)
    (tmp_path / "other.txt").touch()
    (tmp_path / "b c%20.zip").touch()
    with pytest.raises(landing.RejectedArchive, match="bytes: [^;]*b c%20.zip: size is 0$"):
        landing.archives(spark, str(tmp_path))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeff".encode() + (",".join(INVOICE_FIELDS) + '\n1,A,"x, ""y""\nz",1,d,1,,X\n').encode())
    row = landing.csv_lines(spark, str(tmp_path / "a.csv")).first()
    assert (row.InvoiceNo, row.Description) == ("1", 'x, "y"\nz')
    (tmp_path / "a.json").write_text('{"k":"1"}\n{"k":"2","v":3}\n')
    got = landing.json_files(spark, str(tmp_path / "a.json"), "k string, v int").orderBy("k").collect()
    assert [(r.k, r.v) for r in got] == [("1", None), ("2", 3)] and got[0].source_file.endswith("a.json")
    landing.append_lines(spark.createDataFrame([("t", "x"), ("u", "y")], "topic string, raw_payload string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    landing.export_ordered(spark.range(100).repartition(3), str(tmp_path / "sorted"), ["id"])
    files = sorted((tmp_path / "sorted").glob("part-*"))
    assert [json.loads(x)["id"] for f in files for x in f.read_text().splitlines()] == list(range(100))


def test_failed_gold_build_commits_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "work")
    cli.produce(spark, root, 20, "normal", 1)
    cli.process(spark, root)
    monkeypatch.setattr(ops, "validate_snapshot", lambda document: ["wrong"])
    with pytest.raises(ops.Unreconciled):
        cli.build_gold(spark, root)
    assert not (tmp_path / "work" / "gold").exists()


def test_overflow_in_a_later_mart_leaves_all_as_they_were(spark, tmp_path):
    """Each line fits its type, the sum of an order doesn't: nothing of the second build is committed."""
    from tidemill.sources.versioned import VersionedTable
    from tidemill.streaming.bronze_silver import Lakehouse

    root, ddl = str(tmp_path / "work"), "event_id string, event_type string, customer_id string, product_id string, order_id string, quantity int, price string, country string, event_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz"
    row = lambda n, q, p: (f"5021dc2f-001f-4627-a4be-0b543624c79{n}", "purchase", "c", "p", "o", q, p, "X", T, T)
    silver = Lakehouse(spark, f"file://{root}/lake").silver
    silver.append(spark.createDataFrame([row(1, 2, "1.005")], ddl))
    cli.build_gold(spark, root)
    tables = {n: VersionedTable(spark, f"file://{root}/gold/{n}") for n in ("fact_order_items", "fact_orders", "daily_sales", "dim_customer")}
    before = {n: t.versions() for n, t in tables.items()}
    silver.append(spark.createDataFrame([row(n, 1_000_000, "9999999999.99") for n in (2, 3)], ddl))
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        cli.build_gold(spark, root)
    assert {n: t.versions() for n, t in tables.items()} == before
    assert str(tables["fact_orders"].read().first().order_total) == "2.02" and silver.read().count() == 3


def test_failed_runs_report_failure():
    run = dict.fromkeys(ops.COUNTS, 0) | {"run_id": "r", "status": "FAILED"}
    assert "tidemill_pipeline_failed 1" in ops.metrics_text(run, alerts=1)
    text = ops.incident_report(run, [{"metric": "pipeline_failure", "value": 1.0, "threshold": 0.0, "severity": "critical"}])
    assert "cause:" in text and text == ops.incident_report(run, [{"metric": "pipeline_failure", "value": 1.0, "threshold": 0.0, "severity": "critical"}])


def test_age_label():
    assert [ops.age_label(T, T.replace(**k)) for k in ({"minute": 0}, {"minute": 1}, {"minute": 59}, {"hour": 5, "minute": 59}, {"day": 2}, {"year": 2025})] == [
        "just now", "1 minute ago", "59 minutes ago", "5 hours ago", "1 day ago", "just now",
    ]
