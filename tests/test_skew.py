from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemill.operators import skew

DDL = "k string, c string, v int"


def test_against_brute_force(spark):
    data = [("hot" if i % 3 else [None, "a", "b", "warm"][i % 4], f"c{i % 17}" if i % 5 else None, i % 7 or None) for i in range(3000)]
    frame = spark.createDataFrame(data, DDL)
    got = skew.salted_aggregate(frame, "k", sums={"s": F.col("v").cast("long")}, maxima={"m": F.col("v")}, distinct={"d": "c"}, share=0.1, salts=8)
    want = defaultdict(lambda: [0, 0, 0, set()])
    for k, c, v in data:
        w = want[k]
        w[0] += 1
        w[1] += v or 0
        w[2] = max(w[2], v or 0)
        w[3] |= {c} - {None}
    assert {r.k: (r.n, r.s, r.m, r.d) for r in got.collect()} == {k: (w[0], w[1], w[2], len(w[3])) for k, w in want.items()}


def test_report_threshold_counts_nulls_in_total(spark):
    frame = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)] * 91, "k string")
    assert {r.k: r.n for r in skew.heavy_report(frame, "k", 0.05).collect()} == {"a": 5}
    assert skew.heavy_report(frame.limit(0), "k", 0.05).count() == 0
    # the list that steers salting holds all heavy keys once each, and no more than 1/share in all
    listed = Counter(r["__heavy"] for r in skew.heavy_keys(frame, "k", 0.05).collect())
    assert {"a", None} <= listed.keys() and max(listed.values()) == 1 and len(listed) <= 20
