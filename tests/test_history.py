import random
from datetime import datetime as D
from datetime import timedelta

import pytest

from tidemill.operators import history

DDL = "k string, v timestamp_ntz, r timestamp_ntz, a string"
T0 = D(2020, 1, 1)


def brute(updates):
    """Apply updates in recorded order (ties in valid order) to a timeline per key; believed intervals with recorded spans."""
    ledger = []
    for key in {u[0] for u in updates}:
        mine = sorted({u for u in updates if u[0] == key}, key=lambda u: (u[2], u[1], (u[3] is not None, u[3])))
        live = []  # [attrs, from, to, recorded_from]
        for _, v, r, a in mine:
            nxt = None
            for row in list(live):
                if row[1] <= v and (row[2] is None or v < row[2]):
                    nxt = row[2]
                    live.remove(row)
                    ledger.append((key, row[0], row[1], row[2], row[3], r))
                    if row[1] < v:
                        live.append([row[0], row[1], v, r])
                    break
            else:
                later = [row[1] for row in live if row[1] > v]
                nxt = min(later) if later else None
            live.append([a, v, nxt, r])
        ledger += [(key, *row, None) for row in live]
    return sorted((x for x in ledger if x[5] is None or x[5] > x[4]), key=str)


def ours(spark, updates):
    book = history.ledger(spark.createDataFrame(updates, DDL), ["k"], "v", "r", ["a"])
    return book, sorted(((r.k, r.attrs.a, r.valid_from, r.valid_to, r.recorded_from, r.recorded_to) for r in book.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ledger_equals_sequential_application(spark, seed):
    rnd = random.Random(seed)
    updates = []
    for key in ("x", "y", None):
        for i in range(40):
            v = T0 + timedelta(days=3 * rnd.randrange(60))
            late = timedelta(days=rnd.choice([0, 0, 0, 1, 20, 90]))
            updates.append((key, v, v + late, rnd.choice(["p", "q", None])))
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(seed * 3))  # runs broken off by batches
    try:
        _, got = ours(spark, updates + updates[:5])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert got == brute(updates)


def test_versions_join_equal_neighbours_and_returns(spark):
    day = lambda n: T0 + timedelta(days=n)
    updates = [("x", day(1), day(1), "p"), ("x", day(2), day(2), "p"), ("x", day(3), day(3), None), ("x", day(70), day(70), "p"), ("x", day(70), day(70), "p")]
    book, _ = ours(spark, updates)
    got = sorted((r.valid_from, r.valid_to, r.attrs.a) for r in history.versions(book, ["k"]).collect())
    assert got == [(day(1), day(3), "p"), (day(3), day(70), None), (day(70), None, "p")]
    assert sorted(r.valid_from for r in history.version_starts(book, ["k"]).collect()) == [g[0] for g in got]


def test_late_update_splits(spark):
    day = lambda n: T0 + timedelta(days=n)
    _, got = ours(spark, [("x", day(1), day(1), "p"), ("x", day(9), day(9), "q"), ("x", day(5), day(20), "m")])
    assert ("x", "p", day(1), day(9), day(9), day(20)) in got and ("x", "p", day(1), day(5), day(20), None) in got and ("x", "m", day(5), day(9), day(20), None) in got


def test_snapshots_with_gaps(spark):
    d = lambda n: (T0 + timedelta(days=n)).date()
    rows = [(d(0), "x", 1), (d(5), "x", 1), (d(15), "x", 1), (d(0), "y", 2), (d(5), "y", 3), (d(10), "y", 3), (d(15), "y", None), (d(15), "y", None)]
    snaps = spark.createDataFrame(rows, "s date, k string, p int")
    book = history.ledger(history.snapshots_to_updates(snaps, ["k"], "s", ["p"]), ["k"], "s", "s", ["p", "absent"])
    got = sorted((r.k, r.valid_from, r.valid_to, r.attrs.p) for r in history.versions(book, ["k"], absent="absent").collect())
    assert got == [("x", d(0), d(10), 1), ("x", d(15), None, 1), ("y", d(0), d(5), 2), ("y", d(5), d(15), 3), ("y", d(15), None, None)]


def test_empty_and_undated(spark):
    book, got = ours(spark, [("x", None, T0, "p")])
    assert got == [] and history.versions(book, ["k"]).count() == 0
