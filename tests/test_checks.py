from datetime import datetime as D
from decimal import Decimal

import pytest

from tidemill.operators import checks, history
from tidemill.plans import gold, models
from tidemill.sources.versioned import VersionedTable


def test_every_kind_of_check(spark):
    child = spark.createDataFrame([(1, "a", 5), (1, None, -1), (None, "z", 0)], "k int, p string, n int")
    parent = spark.createDataFrame([("a",)], "id string")
    tests = (
        checks.Check("c", "unique", "k"), checks.Check("c", "not_null", "k"), checks.Check("c", "accepted", "p", ("a",)), checks.Check("c", "relationship", "p", to=("p", "id")),
        checks.Check("c", "rows", failing="n <= 0"), checks.Check("p", "unique", "id"),
    )
    got = {r.check: r.failures for r in checks.run({"c": child, "p": parent}, tests).collect()}
    assert got == {"c.unique:k": 1, "c.not_null:k": 1, "c.accepted:p": 1, "c.relationship:p": 1, "c.rows:n <= 0": 2, "p.unique:id": 0}
    assert all(r.failures == 0 for r in checks.run({"c": child.limit(0), "p": parent.limit(0)}, tests).collect())
    assert len(checks.GOLD) == 26 and sum(c.kind == "rows" for c in checks.GOLD) == 3


def test_verifiers():
    first = {"items": {"valid": 10, "silver": 9, "rejected": 1}, "orders": {"valid": 3, "silver": 3, "rejected": 0}}
    second = {"items": {"valid": 10, "silver": 9, "rejected": 2}, "orders": {"valid": 3, "silver": 3, "rejected": 0}}
    assert checks.compare_deliveries(first, second, {"items": 1}) == []
    assert len(checks.compare_deliveries(first, second, {})) == 1 and len(checks.compare_deliveries(second, first | {"orders": {}}, {})) == 3
    run = {"records_read": 40, "records_written": 30, "records_duplicate": 4}
    assert checks.accept_replay(run, {"records_read": 40, "records_written": 0, "records_duplicate": 34}) == []
    assert len(checks.accept_replay(run, {"records_read": 39, "records_written": 1, "records_duplicate": 0})) == 3


def test_latest_success_ignores_failures(spark):
    ddl = "status string, completed_at timestamp_ntz"
    a = spark.createDataFrame([("SUCCESS", D(2026, 1, 1)), ("FAILED", D(2026, 1, 5))], ddl)
    got = {r.stage: r.latest_success for r in checks.latest_success({"a": a, "b": a.where("status = 'FAILED'")}).collect()}
    assert got == {"a": D(2026, 1, 1), "b": None, "any": D(2026, 1, 1)}


def test_snapshot_merge_closes_and_opens(spark, tmp_path):
    """Three versions and one current after two changes; unchanged and missing keys write nothing."""
    table, ddl = VersionedTable(spark, f"file://{tmp_path}/s"), "id string, price decimal(12,2)"
    put = lambda rows, day: history.merge_snapshot(table, spark.createDataFrame(rows, ddl), ["id"], ["price"], D(2026, 1, day))
    put([("p", Decimal(5)), ("q", None)], 1)
    put([("p", Decimal(6)), ("q", None), ("r", Decimal(1))], 2)
    n = table.versions()
    assert put([("p", Decimal(6)), ("q", None)], 3) == {"inserted": 0, "updated": 0, "deleted": 0} and table.versions() == n
    put([("p", None)], 4)
    put([("p", Decimal(7))], 4)  # a second change at the same time replaces the first
    rows = sorted((r.id, r.valid_from.day, r.valid_to and r.valid_to.day, r.price) for r in table.read().collect())
    assert rows == [("p", 1, 2, Decimal(5)), ("p", 2, 4, Decimal(6)), ("p", 4, None, Decimal(7)), ("q", 1, None, None), ("r", 2, None, Decimal(1))]
    assert {r.id: r.ok for r in checks.accept_history(table.read(), "id").collect()} == {"p": True, "q": False, "r": False}


def test_materializations(spark, tmp_path):
    ddl = "id string, v int"
    made = (
        models.Model("seen", models.VIEW, lambda t: t["src"].where("v > 0")), models.Model("copy", models.TABLE, lambda t: t["seen"]),
        models.Model("kept", models.INCREMENTAL, lambda t: t["seen"], key=("id",)), models.Model("past", models.SNAPSHOT, lambda t: t["copy"], key=("id",), attributes=("v",)),
    )
    run = lambda rows, day, **k: models.build(spark, f"file://{tmp_path}", made, {"src": spark.createDataFrame(rows, ddl)}, D(2026, 1, day), **k)
    run([("a", 1), ("b", 0)], 1)
    assert run([("a", 2), ("c", 3)], 2)["kept"] == {"inserted": 1, "updated": 1, "deleted": 0}
    kept = VersionedTable(spark, f"file://{tmp_path}/kept")
    n = kept.versions()
    run([("a", 2), ("c", 3)], 3)
    assert kept.versions() == n and sorted(map(tuple, kept.read().collect())) == [("a", 2), ("c", 3)]
    run([("z", 9)], 4, full_refresh=True)
    assert [r.id for r in kept.read().collect()] == ["z"] and VersionedTable(spark, f"file://{tmp_path}/past").read().count() == 4
    before = kept.versions()
    broken = (*made, models.Model("bad", models.TABLE, lambda t: t["src"].selectExpr("1 / (v - 9) AS x")))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        models.build(spark, f"file://{tmp_path}", broken, {"src": spark.createDataFrame([("z", 9)], ddl)}, D(2026, 1, 5))
    assert kept.versions() == before
    with pytest.raises(ValueError):
        models.Model("x", models.INCREMENTAL, lambda t: t["src"])


def test_item_only_arrivals(spark):
    """Lines that arrive without a new header: 3 units 25.00, then 5 and 33.00, corrected to 6 and 37.00, nothing, then another day."""
    o_ddl = "order_id string, customer_id string, order_timestamp timestamp_ntz, country string, ingestion_timestamp timestamp_ntz"
    i_ddl = "_record_hash string, order_id string, product_id string, quantity int, unit_price decimal(12,2), ingestion_timestamp timestamp_ntz"
    orders = [("O", "C", D(2026, 1, 1), "X", D(2026, 1, 1))]
    items = [("a", "O", "P", 2, Decimal(10), D(2026, 1, 1)), ("b", "O", "P", 1, Decimal(5), D(2026, 1, 1))]
    stored = None
    steps = []
    for new_items, new_orders in (([], []), ([("c", "O", "P", 2, Decimal(4), D(2026, 1, 2))], []), ([("d", "O", "P", 1, Decimal(4), D(2026, 1, 3))], []), ([], []), ([], [("O", "C", D(2026, 1, 3), "X", D(2026, 1, 4))])):
        items, orders = items + new_items, orders + new_orders
        i, o = spark.createDataFrame(items, i_ddl), spark.createDataFrame(orders, o_ddl)
        full = gold.fact_orders(gold.distinct_items(i), gold.current_orders(o))
        if stored is None:
            stored = full
        else:
            delta = gold.fact_orders_delta(i, o, stored)
            steps.append(delta.count())
            stored = spark.createDataFrame(gold.apply_delta(stored, delta, "order_id").collect(), full.schema)
        [row] = stored.collect()
        steps.append((row.units, str(row.order_total), row.order_timestamp.day))
        assert stored.exceptAll(full).count() == 0
    assert steps == [(3, "25.00", 1), 1, (5, "33.00", 1), 1, (6, "37.00", 1), 0, (6, "37.00", 1), 1, (6, "37.00", 3)]
