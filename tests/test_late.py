from datetime import datetime as D
from decimal import Decimal

from pyspark.sql import functions as F

from tidemill.operators import late

DDL = "id string, e timestamp_ntz, a timestamp_ntz, order_id string, quantity int, price decimal(12,2)"


def events(spark, rows):
    return spark.createDataFrame(rows, DDL)


def messages(spark, rows):
    return late.first_arrivals(events(spark, rows), F.col("id"), "e", "a", ("order_id", "quantity", "price"))


def test_status_boundaries_and_first_arrival(spark):
    t = D(2020, 1, 1, 10)
    rows = [
        ("exact30", t, D(2020, 1, 1, 10, 30), None, 1, None),
        ("late", t, D(2020, 1, 1, 10, 30, 0, 1), None, 1, None),
        ("exact48", t, D(2020, 1, 3, 10), None, 1, None),
        ("over", t, D(2020, 1, 3, 10, 0, 0, 1), None, 1, None),
        ("ahead", t, D(2020, 1, 1, 9), None, 1, None),
        ("twice", t, D(2020, 1, 1, 10, 1), None, 1, None),
        ("twice", t, D(2020, 1, 2, 10), None, 1, None),
        ("no_event", None, t, None, 1, None),
        ("no_arrival", t, None, None, 1, None),
        ("one_known", t, None, None, 1, None),
        ("one_known", t, D(2020, 1, 1, 10, 5), None, 1, None),
        (None, t, t, None, 1, None),
    ]
    got = {r.message: r.status for r in messages(spark, rows).collect()}
    assert got == {
        "exact30": "on_time", "late": "late", "exact48": "late", "over": "refused", "ahead": "on_time", "twice": "on_time",
        "no_event": "undated", "no_arrival": "undated", "one_known": "on_time",
    }


def test_corrections_add_up(spark):
    t = D(2020, 1, 1, 10)
    rows = [("1", t, D(2020, 1, 1, 10, 5), "o1", 2, Decimal(3)), ("2", t, D(2020, 1, 1, 12), "o1", 1, Decimal(5)), ("3", t, D(2020, 1, 2, 12), "o2", None, None)]
    store = late.partials(messages(spark, rows))
    steps = [(r.orders, r.units, float(r.revenue)) for r in late.corrections(store).orderBy("arrival_batch").collect()]
    assert steps == [(1, 2, 6.0), (1, 3, 11.0), (2, 3, 11.0)]
    total = late.combine(store).first()
    assert (total.orders, total.lines, total.late_lines, total.units) == (2, 3, 2, 3)


def test_empty(spark):
    assert late.corrections(late.partials(messages(spark, []))).count() == 0


def test_deliveries_with_repeats_split_orders_and_refusals(spark, tmp_path):
    """Two deliveries, each from its own raw rows, give what both give at once."""
    t, one = D(2020, 1, 5, 10), Decimal(1)
    first = [
        ("a", t, D(2020, 1, 5, 10, 5), "o1", 2, Decimal(3)),
        ("b", t, D(2020, 1, 5, 11), "o2", 1, one),
        ("n", t, None, "o5", 9, one),
        ("old", D(2020, 1, 1, 10), D(2020, 1, 5, 12), "o4", 1, one),
    ]
    second = [
        ("a", t, D(2020, 1, 6, 9), "o1", 2, Decimal(3)),  # a repeat
        ("b", D(2020, 1, 6, 8), D(2020, 1, 6, 9), "o2", 1, one),  # a repeat that claims another day
        ("c", t, D(2020, 1, 6, 9), "o1", 4, Decimal(2)),  # the order's other line
        ("n", t, D(2020, 1, 6, 9), "o5", 9, one),  # known now
        ("old", D(2020, 1, 1, 10), D(2020, 1, 6, 9), "o4", 1, one),  # refused before
        ("over", D(2020, 1, 3, 10), D(2020, 1, 6, 9), "o6", 1, one),
    ]
    store = late.LateStore(spark, str(tmp_path))
    store.deliver("1", messages(spark, first))
    assert {r.message for r in store.refused_messages().collect()} == {"old"}
    store.deliver("2", messages(spark, second))
    assert {(r.message, r.verdict) for r in store.refused_messages().collect()} == {("old", "refused"), ("over", "refused")}
    whole = late.combine(late.partials(messages(spark, first + second))).collect()
    assert store.figures().collect() == whole and [(r.orders, r.lines, r.units) for r in whole] == [(3, 4, 16)]
    assert {r.message for r in store.late_messages().collect()} == {"b", "c", "n"}
    # a delivery that comes again under its name changes nothing, nor does one of known messages
    store.deliver("2", messages(spark, second))
    store.deliver("3", messages(spark, second))
    assert late.LateStore(spark, str(tmp_path)).figures().collect() == whole


def test_delivery_refuses_closed_periods_and_sees_other_messages(spark, tmp_path):
    t, bought = D(2020, 1, 5, 10), F.col("order_id").isNotNull()
    store = late.LateStore(spark, str(tmp_path))
    store.deliver("1", messages(spark, [("a", t, t, "o1", 1, None), ("view", t, t, None, 1, None)]), bought, t.date())
    store.deliver("2", messages(spark, [("view", t, D(2020, 1, 6), "o2", 1, None), ("z", t, D(2020, 1, 6), "o3", 1, None)]), bought)
    assert [(r.message, r.verdict) for r in store.refused_messages().collect()] == [("z", "closed")]
    assert [(r.orders, r.lines) for r in store.figures().collect()] == [(1, 1)]
    store.deliver("3", messages(spark, []), bought)  # still closed
    store.deliver("4", messages(spark, [("y", t, D(2020, 1, 6), "o4", 1, None)]), bought)
    assert store.figures().first().lines == 1


def test_crash_between_tables_is_taken_back(spark, tmp_path, monkeypatch):
    t = D(2020, 1, 5, 10)
    store = late.LateStore(spark, str(tmp_path))
    store.deliver("1", messages(spark, [("a", t, t, "o1", 1, None)]))
    before = store.figures().collect()
    with monkeypatch.context() as m:
        m.setattr(store.commits, "mark", lambda rows: (_ for _ in ()).throw(RuntimeError("crash")))
        try:
            store.deliver("2", messages(spark, [("b", t, t, "o1", 2, None)]))
        except RuntimeError:
            pass
    assert store.figures().collect() == before
    store.deliver("2", messages(spark, [("b", t, t, "o1", 2, None)]))
    assert [(r.orders, r.lines, r.units) for r in store.figures().collect()] == [(1, 2, 3)]


def test_registered_deliveries(spark, tmp_path):
    from tidemill.plans import problems

    ids = [f"5021dc2f-001f-4627-a4be-0b543624c79{n}" for n in range(4)]
    e = D(2015, 2, 14, 20)
    rows = [
        (ids[0], "purchase", "o1", 1, Decimal(2), e, D(2015, 2, 14, 21)),
        (ids[0], "purchase", "o1", 1, Decimal(2), e, D(2015, 2, 28, 9)),
        (ids[1], "purchase", "o1", 3, Decimal(1), e, D(2015, 2, 15, 9)),
        (ids[2], "purchase", "o2", 1, Decimal(1), D(2015, 2, 10), D(2015, 2, 15, 9)),
        (ids[3], "purchase", "o3", 1, Decimal(1), D(2015, 2, 26, 23), D(2015, 2, 28, 9)),
    ]
    ddl = "event_id string, event_type string, order_id string, quantity int, price decimal(12,2), event_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "silver_events.parquet"))
    got = problems.p2_incremental(spark, str(tmp_path)).orderBy("order_date").collect()
    assert [(r.orders, r.units, float(r.revenue), r.late_lines) for r in got] == [(1, 4, 5.0, 2), (1, 1, 1.0, 1)]
    assert {(r.event_id, r.reason) for r in problems.p2_refused(spark, str(tmp_path)).collect()} == {(ids[2], "refused"), (ids[3], "closed")}
    assert {r.event_id for r in problems.p2_found(spark, str(tmp_path)).collect()} == {ids[0], ids[1], ids[3]}
