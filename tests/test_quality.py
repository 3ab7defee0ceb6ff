from datetime import datetime as D
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.operators import quality
from tidemill.plans import gold, kpi


def test_split_is_null_safe(spark):
    frame = spark.createDataFrame([("o", "p", 1, Decimal(1)), ("o", "p", None, Decimal(1)), (None, "p", 1, Decimal(1)), ("o", " ", 1, Decimal(1)), ("o", "p", 0, Decimal(1)), ("o", "p", 1, Decimal(-1))], "order_id string, product_id string, quantity int, unit_price decimal(12,2)")
    good, bad = quality.split(frame, quality.rules()["order_items"])
    assert (good.count(), bad.count()) == (1, 5)
    assert {r.error_type for r in quality.quarantine(bad, "order_items", "m").collect()} == {"BUSINESS_RULE"}


def test_normalize_invoices_keeps_the_last_row(spark):
    lines = [
        (1, "1", "A", "old", "2", "12/1/2010 8:26", "1.005", "9", "X"), (2, "1", "A", "new", "3", "2010-12-01 08:26:00", "2.00", "9", "Y"),
        (3, "C2", "B", "b", "-1", "bad", "1", "", "Z"), (4, "", "B", "b", "1", "", "1", "", ""), (5, "3", " ", "b", "1", "", "1", "", ""),
    ]
    names = "seq int, InvoiceNo string, StockCode string, Description string, Quantity string, InvoiceDate string, UnitPrice string, CustomerID string, Country string"
    made = quality.normalize_invoices(spark.createDataFrame(lines, names), "seq")
    assert [(r.customer_id, r.country) for r in made["customers"].collect()] == [("9", "Y")]
    assert sorted((r.product_id, r.description, str(r.unit_price)) for r in made["products"].collect()) == [("A", "new", "2.00"), ("B", "b", "1.00")]
    orders = {r.order_id: r for r in made["orders"].collect()}
    assert orders["1"].order_timestamp == D(2010, 12, 1, 8, 26) and orders["C2"].is_cancelled == "true" and orders["C2"].order_timestamp is None and orders["C2"].customer_id is None
    assert sorted((r.order_id, str(r.unit_price)) for r in made["order_items"].collect()) == [("1", "1.01"), ("1", "2.00"), ("C2", "1.00")]


def events(spark, rows):
    ddl = "event_id string, event_type string, customer_id string, product_id string, order_id string, country string, quantity int, price string, event_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz"
    return gold.stg_events(spark.createDataFrame(rows, ddl))


def test_half_up_before_multiplying_and_overflow_fails(spark):
    t = D(2026, 1, 1)
    one = lambda n, p: (f"5021dc2f-001f-4627-a4be-0b54362400{n:02d}", "purchase", "c", "p", f"o{n}", "x", 2, p, t, t)
    made = gold.fact_orders_from_events(events(spark, [one(1, "1.005"), one(2, "0.145"), one(3, "0.1234567890123456789012345")])).collect()
    assert {r.order_id: str(r.order_total) for r in made} == {"o1": "2.02", "o2": "0.30", "o3": "0.24"}
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        gold.fact_orders_from_events(events(spark, [one(1, "9999999999.995")])).collect()


def test_incremental_equals_full_refresh_after_ties_and_moved_dates(spark):
    d = lambda n, h=0: D(2026, 1, n, h)
    oddl = "order_id string, customer_id string, order_timestamp timestamp_ntz, country string, ingestion_timestamp timestamp_ntz"
    iddl = "_record_hash string, order_id string, product_id string, quantity int, unit_price decimal(12,2), ingestion_timestamp timestamp_ntz"
    orders = [("o1", "c", d(1), "x", d(1)), ("o2", "c", d(2), "x", d(2))]
    items = [("i1", "o1", "p", 2, Decimal("10.00"), d(1)), ("i2", "o1", "p", 1, Decimal("5.00"), d(2)), ("i3", "o2", "p", 3, Decimal("7.00"), d(2))]
    stored = gold.fact_orders(spark.createDataFrame(items, iddl), spark.createDataFrame(orders, oddl))
    items += [("i4", "o1", "p", 2, Decimal("4.00"), d(2))]  # a tie with the high-water mark
    orders[1] = ("o2", "c", d(3), "x", d(3))
    items_f, orders_f = spark.createDataFrame(items, iddl), spark.createDataFrame(orders, oddl)
    delta = gold.fact_orders_delta(items_f, orders_f, stored)
    full = gold.fact_orders(items_f, orders_f)
    now = gold.apply_delta(stored, delta, "order_id")
    assert now.exceptAll(full).count() == full.exceptAll(now).count() == 0 and delta.count() == 2
    gone = gold.without_parent(gold.daily_sales(stored), now)
    assert [str(r.order_date) for r in gone.collect()] == ["2026-01-02"]
    assert gold.fact_orders_delta(items_f, orders_f, now).count() == 0


def test_empty_reports(spark):
    none = events(spark, [])
    row = kpi.summary(gold.fact_orders_from_events(none)).first()
    assert (row.orders, row.units, str(row.revenue), row.average_order_value) == (0, 0, "0.00", 0.0)
    assert gold.dim_date(gold.fact_orders_from_events(none)).count() == 0
    assert kpi.conversion(none).first().ratio is None


def test_alert_boundaries(spark):
    runs = spark.createDataFrame([("a", "SUCCESS", 100, 5, 2, 5), ("b", "FAILED", 100, 6, 3, 6), ("c", "SUCCESS", 0, 0, 0, 0)], "run_id string, status string, records_read long, records_duplicate long, records_rejected long, records_late long")
    got = sorted((r.run_id, r.metric) for r in kpi.alerts(kpi.run_rates(runs)).collect())
    assert got == [("b", m) for m in ("duplicate_rate", "late_event_rate", "pipeline_failure", "rejection_rate")]


def test_stale_boundary(spark):
    t = D(2026, 1, 1)
    e = events(spark, [("5021dc2f-001f-4627-a4be-0b5436240001", "inventory_update", None, "p", None, None, 4, None, t, t), ("5021dc2f-001f-4627-a4be-0b5436240002", "search", None, "q", None, None, None, None, t, t)])
    at = lambda minutes: {r.product_id: (r.inventory_status, r.units_updated) for r in gold.inventory_health(e, F.lit(D(2026, 1, 1, 1, minutes))).collect()}
    assert at(0) == {"p": ("healthy", 4), "q": ("unknown", 0)} and at(1)["p"][0] == "stale"
