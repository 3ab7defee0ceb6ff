import random
from datetime import datetime as D
from datetime import timedelta

from tidemill.operators import orphans

T0 = D(2020, 1, 1)
REF = "id int, ref string, at timestamp_ntz, key string, born string"
PAR = "k string, born timestamp_ntz, died timestamp_ntz, code int"


def test_against_brute_force(spark):
    rnd = random.Random(4)
    when = lambda: T0 + timedelta(hours=rnd.randrange(240))
    parents = [(f"p{i}", when(), when() if rnd.random() < 0.3 else None, 1) for i in range(300)] + [("p1", T0, None, 2), ("p2", None, None, 1), (None, T0, None, 1)]
    refs = [(i, "hot" if i % 3 == 0 else rnd.choice([None, *[f"p{j}" for j in range(330)]]), when() if i % 50 else None, "x", "y") for i in range(3000)]
    refs += refs[:20]
    born, died = {}, {}
    for k, b, d, _ in parents:
        if b is not None:
            born[k] = min(b, born.get(k, b))
        if d is not None:
            died[k] = min(d, died.get(k, d))

    def orphan(ref, at):
        if ref is None:
            return False
        if ref not in born:
            return True
        return at is not None and (born[ref] > at or (ref in died and died[ref] <= at))

    found = orphans.orphans(spark.createDataFrame(refs, REF), "ref", "at", spark.createDataFrame(parents, PAR), "k", "born", "died")
    assert sorted(r.id for r in found.collect()) == sorted(r[0] for r in refs if orphan(r[1], r[2]))
    report = orphans.report(found, "t", "ref").collect()
    assert sum(r.orphan_rows for r in report) == found.count() and {r.table_name for r in report} == {"t"}


def test_empty_sides(spark):
    refs, none = spark.createDataFrame([(1, "a", T0, "", "")], REF), spark.createDataFrame([], PAR)
    assert orphans.orphans(refs, "ref", "at", none, "k", "born").count() == 1
    assert orphans.orphans(refs.limit(0), "ref", "at", none, "k", "born", "died").count() == 0


def test_one_bit_takes_bytes_and_codes_follow_first_use(spark):
    from pyspark.sql import functions as F

    coded = spark.createDataFrame([(40_000, 7), (5, 7), (3, 7)], "code long, period int")
    got = {r.key_range: list(r.spots) for r in orphans.compressed(orphans._bits(coded, "ref")).collect()}
    assert got == {2: [40_000 - 32_768], 1: [3, 5]}
    used = spark.createDataFrame([(f"k{i}", 100 - i) for i in range(50)], "key string, period int")
    none = spark.createDataFrame([("never used", None, None)], "key string, born timestamp_ntz, died timestamp_ntz")
    book = orphans.dictionary(used, none).orderBy(F.col("code")).collect()
    assert [r.key for r in book] == [f"k{i}" for i in range(49, -1, -1)] + ["never used"]
