import pytest
from pyspark.sql import functions as F

from tidemill.functions.identifiers import canonical_uuid, uuid_bytes, uuid_text
from tidemill.operators import dedup

U = "5021dc2f-001f-4627-a4be-0b543624c791"


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        (U, True), (U.upper(), True), (U.replace("-", ""), True), ("{" + U + "}", True), ("urn:uuid:" + U, True), ("URN:UUID:" + U, False),
        ("{" + U.replace("-", "") + "}", False), ("{" + U, False), (U + "}", False), (U + " ", False), (U + "\n", False), (U[:-1], False), ("", False), (None, False),
        (U.replace("-", "", 1), False),
    ],
)
def test_uuid_spellings(spark, text, ok):
    row = spark.createDataFrame([(text,)], "x string").select(canonical_uuid(F.col("x")).alias("c"), uuid_text(uuid_bytes(F.col("x"))).alias("b")).first()
    assert row.c == row.b == (U if ok else None)


def write(spark, path, rows, files):
    frame = spark.createDataFrame(rows, "id string, at int, payload string, bits string")
    for n in range(files):
        frame.where(F.col("at") % files == n).coalesce(1).write.mode("append").parquet(path)
    return frame


@pytest.fixture(params=[{}, {"PER_FOLDER": 100, "WINDOW": 1, "HOT": "0.9"}])
def layout(request, monkeypatch):
    """As it is, and with several folders, narrow windows and no salting."""
    for name, value in request.param.items():
        monkeypatch.setattr(dedup, name, value)


def test_keep_first(spark, tmp_path, layout):
    rows = [(f"m{i % 700}" if i % 9 else "hot", i, f"p{i}", "b") for i in range(2000)] + [(None, 5000, "kept", None), (None, 5001, "kept", None)]
    write(spark, str(tmp_path / "t"), rows, 3)
    got = dedup.keep_first(spark, str(tmp_path / "t"), lambda f: f["id"], ("at",)).collect()
    first = {}
    for r in sorted(rows[:2000], key=lambda r: r[1]):
        first.setdefault(r[0], r)
    assert sorted((r.id, r.at, r.payload) for r in got if r.id) == sorted(r[:3] for r in first.values())
    assert sum(r.id is None for r in got) == 2
    _, n = dedup.losers(dedup.positions(spark.read.parquet(str(tmp_path / "t")), F.col("id"), ("at",)))
    assert n == 2000 - len(first)


def test_more_rows_than_one_bucket(spark, tmp_path, layout):
    path = str(tmp_path / "t")
    spark.range(100_000).select((F.col("id") % 60_000).cast("string").alias("id"), F.col("id").alias("at")).coalesce(1).write.parquet(path)
    got = dedup.keep_first(spark, path, lambda f: f["id"], ("at",))
    assert got.count() == 60_000 and got.agg(F.max("at")).first()[0] == 59_999


def test_empty_and_clash(spark, tmp_path):
    rows = [("a", 1, 1), ("a", 2, 2), ("b", 3, 3)]
    spark.createDataFrame(rows, "id string, __file int, __f int").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = dedup.keep_first(spark, str(tmp_path / "e"), lambda f: f["id"], ("__file",))
    assert got.columns == ["id", "__file", "__f"] and sorted(map(tuple, got.collect())) == [("a", 1, 1), ("b", 3, 3)]
    spark.createDataFrame([], "id string, x int").write.parquet(str(tmp_path / "f"))
    assert dedup.keep_first(spark, str(tmp_path / "f"), lambda f: f["id"]).count() == 0


def test_dedupe_rows_ties(spark):
    frame = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("b", None, "z")], "k string, at int, v string")
    assert sorted((r.k, r.v) for r in dedup.dedupe_rows(frame, ["k"], [F.col("at")]).collect()) == [("a", "x"), ("b", "z")]


def test_marked_messages(spark, tmp_path, layout):
    rows = [(f"m{i % 700}" if i % 9 else "hot", i, f"p{i}", "b") for i in range(1000)] + [(None, 5000, "kept", None), (None, 5001, "kept", None)]
    write(spark, str(tmp_path / "t"), rows, 3)
    ids = [r[0] for r in rows if r[0]]
    got = [r.message for r in dedup.marked_messages(spark, str(tmp_path / "t"), lambda f: f["id"], ("at",)).collect()]
    assert sorted(got) == sorted({k for k in ids if ids.count(k) > 1})


def test_p4_found_reads_deletion_vectors(spark, tables, monkeypatch):
    from tidemill.plans import problems

    built = []
    real = dedup.deletion_vectors
    monkeypatch.setattr(dedup, "deletion_vectors", lambda spark, narrow: built.append(1) or real(spark, narrow.limit(0)))
    assert problems.p4_found(spark, tables).count() == 0 and len(built) == 2
