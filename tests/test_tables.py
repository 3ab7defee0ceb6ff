import pytest
from pyspark.sql import functions as F

from tidemill.sources.versioned import CommitConflict, VersionedTable

DDL = "k string, v int"


def table(spark, tmp_path, rows=()):
    t = VersionedTable(spark, f"file://{tmp_path}/a table")
    t.create(spark.createDataFrame([], DDL).schema)
    if rows:
        t.append(spark.createDataFrame(list(rows), DDL))
    return t


def read(t, version=None):
    return sorted(((r.k, r.v) for r in t.read(version).collect()), key=str)


def test_insert_only_keeps_repeats_within_a_delivery_and_makes_no_empty_version(spark, tmp_path):
    t = table(spark, tmp_path, [("a", 1)])
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 2), (None, 3)], DDL)
    assert t.merge_insert_only(new, ["k"])["inserted"] == 3
    n = t.versions()
    assert t.merge_insert_only(new.where("k is not null"), ["k"])["inserted"] == 0 and t.versions() == n
    assert read(t) == [("a", 1), ("b", 2), ("b", 2), (None, 3)]


def test_merge_current_rewrites_touched_files_only(spark, tmp_path):
    t = table(spark, tmp_path, [("a", 1)])
    t.append(spark.createDataFrame([("b", 1), ("c", 1)], DDL))
    before = t.manifest()["files"]
    got = t.merge_current(spark.createDataFrame([("b", 2), ("d", 4), ("a", 1)], DDL), ["k"])
    assert (got["updated"], got["inserted"]) == (1, 1)
    assert read(t) == [("a", 1), ("b", 2), ("c", 1), ("d", 4)] and set(before) & set(t.manifest()["files"])
    assert read(t, 2) == [("a", 1), ("b", 1), ("c", 1)]  # earlier versions stay readable
    n = t.versions()
    assert t.merge_current(spark.createDataFrame([("b", 2)], DDL), ["k"]) == {"inserted": 0, "updated": 0, "deleted": 0} and t.versions() == n
    with pytest.raises(ValueError):
        t.merge_current(spark.createDataFrame([("b", 2), ("b", 3)], DDL), ["k"])


def test_delete_evolve_history_conflict(spark, tmp_path):
    t = table(spark, tmp_path, [("a", 1), ("b", 2)])
    assert t.delete_keys(spark.createDataFrame([("a",), ("z",)], "k string"), ["k"])["deleted"] == 1
    assert t.delete_keys(spark.createDataFrame([("z",)], "k string"), ["k"])["deleted"] == 0
    t.merge_current(spark.createDataFrame([("c", 3, "x")], DDL + ", w string"), ["k"])
    assert [(r.k, r.w) for r in t.read().orderBy("k").collect()] == [("b", None), ("c", "x")]
    assert [r.operation for r in t.history().orderBy("version").collect()] == ["CREATE", "APPEND", "DELETE", "MERGE"]
    with pytest.raises(CommitConflict):
        t._commit(2, "X", {}, t.read().schema, [])


def test_missing_table_and_nothing_deleted_from_empty(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(spark.createDataFrame([], DDL).schema)
    assert t.read().count() == 0 and t.delete_keys(spark.createDataFrame([("a",)], "k string"), ["k"])["deleted"] == 0
    assert t.read().agg(F.count("v")).first()[0] == 0


def test_a_crash_while_writing_leaves_no_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, [("a", 1)])
    with monkeypatch.context() as m:
        m.setattr(t, "_publish", lambda aside, path: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.append(spark.createDataFrame([("b", 2)], DDL))
    (tmp_path / "a table" / "_log" / ".half").write_text('{"version": 2, "oper')  # a writer that died before publishing
    assert t.versions() == [0, 1] and read(t) == [("a", 1)]
    t.append(spark.createDataFrame([("c", 3)], DDL))
    assert read(t) == [("a", 1), ("c", 3)]


def test_other_errors_are_no_conflict_and_a_hook_publishes(spark, tmp_path):
    t = table(spark, tmp_path, [("a", 1)])
    seen = []
    t.publish = lambda aside, path: (seen.append(path.getName()), VersionedTable._publish(t, aside, path))
    t.append(spark.createDataFrame([("b", 2)], DDL))
    assert seen == [f"{2:020d}.json"] and read(t) == [("a", 1), ("b", 2)]
    t.publish = lambda aside, path: (_ for _ in ()).throw(OSError("no space"))
    with pytest.raises(OSError):
        t.append(spark.createDataFrame([("c", 2)], DDL))


def test_manifests_hold_changes_and_any_version_is_read(spark, tmp_path, monkeypatch):
    from tidemill.sources import versioned

    monkeypatch.setattr(versioned, "CHECKPOINT", 3)
    t = table(spark, tmp_path)
    want = {0: []}
    for n in range(1, 6):
        t.append(spark.createDataFrame([(f"k{n}", n)], DDL))
        want[n] = [*want[n - 1], (f"k{n}", n)]
    t.delete_keys(spark.createDataFrame([("k2",)], "k string"), ["k"])
    want[6] = [r for r in want[5] if r[0] != "k2"]
    t.restore(2)
    want[7] = want[2]
    t.mark({"note": "x"})
    assert all(read(t, n) == rows for n, rows in want.items()) and read(t) == want[2] and t.manifest()["properties"] == {"note": "x"}
    assert '"files": [' not in t._read_text(f"_log/{4:020d}.json")
    assert [r.files for r in t.history().orderBy("version").collect()] == [len(t.manifest(n)["files"]) for n in t.versions()]
