"""Versioned Parquet tables with merges, for engines without a table format.

A table is a folder: immutable Parquet file sets under ``data/``, and one manifest per version under ``_log/`` with
its operation, metrics, schema and files. A manifest is written aside and then gets its name in one step that fails if
the name is taken (a link on local file systems, a rename elsewhere; object stores need a hook), so of two writers one
fails, none overwrites, and a crash leaves no half manifest. Manifests list what a version adds and removes; every
sixteenth lists all files, so a commit costs what it changes and a reader opens at most sixteen. Readers take the files of one version, so a merge may replace files that a
reader still uses. A merge with no effective rows makes no version.

Merges rewrite only the files that hold a matching row; inserts only append files. Tables can be stored by date or any
columns, and files are pruned by Parquet statistics when a merge gives a filter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import materialize, prepare


def _spot(file: str) -> str:
    """A data file by its folder and name, which are unique: readers and listings spell the rest in different ways."""
    return "/".join(file.split("/")[-2:])


#: Every so many versions a manifest lists all files of the table.
CHECKPOINT = 16


class CommitConflict(RuntimeError):
    """Another writer took the version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, publish: Callable | None = None):
        """``publish`` renames a manifest (two Hadoop paths) without overwriting, for stores whose rename isn't atomic."""
        self.spark, self.path, self.publish = prepare(spark), path.rstrip("/"), publish
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files ---------------------------------------------------------------------------------------------------------

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self._conf)

    def _read_text(self, name: str) -> str:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        path, fs = self._at("_log")
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        now = made = json.loads(self._read_text(f"_log/{known[-1] if version is None else version:020d}.json"))
        added: list[str] = []
        gone: set[str] = set()
        while "files" not in made:
            added = [f for f in made["add"] if f not in gone] + added
            gone |= set(made["remove"])
            made = json.loads(self._read_text(f"_log/{made['version'] - 1:020d}.json"))
        return now | {"files": [*(f for f in made["files"] if f not in gone), *added]}

    def _commit(self, version: int, operation: str, metrics: dict, schema: T.StructType, files: list[str], properties: dict | None = None) -> int:
        path, fs = self._at(f"_log/{version:020d}.json")
        entry = {"version": version, "operation": operation, "metrics": metrics, "schema": json.loads(schema.json()), "n_files": len(files), "properties": properties or {}}
        if version % CHECKPOINT:
            before = self.manifest(version - 1)["files"]
            kept, had = set(files), set(before)
            entry |= {"add": [f for f in files if f not in had], "remove": [f for f in before if f not in kept]}
        else:
            entry["files"] = files
        text = json.dumps(entry)
        aside, _ = self._at(f"_log/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        try:
            (self.publish or self._publish)(aside, path)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise CommitConflict(f"version {version} of {self.path} exists") from e
            raise
        finally:
            fs.delete(aside, False)
        return version

    def _publish(self, aside, path) -> None:
        """Give a complete manifest its name, all at once and only if nothing has that name."""
        uri = path.toUri()
        if path.getFileSystem(self._conf).getUri().getScheme() == "file":
            files, local = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            files.createLink(local(path), local(aside))
        else:
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf).rename(aside, path, none)

    def _write(self, frame: DataFrame) -> tuple[list[str], int]:
        """New files and their rows (counted from the files' footers)."""
        name = f"{self.path}/data/{uuid.uuid4().hex}"
        frame.write.parquet(name)
        rows = self.spark.read.schema(frame.schema).parquet(name).count()
        path, fs = self._at(name[len(self.path) + 1 :])
        found = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
        return (sorted(found) if rows else []), rows

    # reading -------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """One version; later commits don't change what this frame reads."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"])
        if not m["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*m["files"])

    def added(self, since: int | None) -> DataFrame:
        """The rows of the files that the newest version lists and version ``since`` (None: none at all) doesn't."""
        m = self.manifest()
        before = set() if since is None else set(self.manifest(since)["files"])
        schema = T.StructType.fromJson(m["schema"])
        new = [f for f in m["files"] if f not in before]
        return self.spark.read.schema(schema).parquet(*new) if new else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """Operation, metrics and number of files of every version; the log is read by Spark, not by the driver."""
        log = "version long, operation string, metrics map<string,string>, n_files int"
        return self.spark.read.schema(log).json(f"{self.path}/_log/*.json").withColumnRenamed("n_files", "files")

    # writing -------------------------------------------------------------------------------------------------------

    def create(self, schema: T.StructType) -> None:
        """An empty version 0, if there is no table."""
        if not self.exists():
            self._commit(0, "CREATE", {"inserted": 0, "updated": 0, "deleted": 0}, schema, [])

    def overwrite(self, frame: DataFrame) -> dict:
        known = self.versions()
        files, rows = self._write(frame)
        metrics = {"inserted": rows, "updated": 0, "deleted": 0}
        self._commit(known[-1] + 1 if known else 0, "WRITE", metrics, frame.schema, files)
        return metrics

    def append(self, frame: DataFrame) -> dict:
        if not self.exists():
            return self.overwrite(frame)
        return self._insert(frame, "APPEND")

    def mark(self, properties: dict) -> None:
        """A new version with the same rows that carries these properties (texts and numbers): one atomic commit."""
        m = self.manifest() if self.exists() else {"version": -1, "schema": json.loads(T.StructType().json()), "files": []}
        self._commit(m["version"] + 1, "MARK", {"inserted": 0, "updated": 0, "deleted": 0}, T.StructType.fromJson(m["schema"]), m["files"], properties)

    def restore(self, version: int | None) -> None:
        """A new version with the rows of an earlier one (None: without any)."""
        now = self.manifest()
        then = now | {"files": []} if version is None else self.manifest(version)
        self._commit(now["version"] + 1, "RESTORE", {"inserted": 0, "updated": 0, "deleted": 0}, T.StructType.fromJson(then["schema"]), then["files"])

    def _evolved(self, m: dict, frame: DataFrame) -> T.StructType:
        old = T.StructType.fromJson(m["schema"])
        return T.StructType([*old.fields, *(f for f in frame.schema.fields if f.name not in old.names)])

    def _insert(self, frame: DataFrame, operation: str) -> dict:
        m = self.manifest()
        files, rows = self._write(frame)
        metrics = {"inserted": rows, "updated": 0, "deleted": 0}
        if rows:
            self._commit(m["version"] + 1, operation, metrics, self._evolved(m, frame), [*m["files"], *files])
        return metrics

    def _same(self, keys: Sequence[str], side: str) -> Column:
        on = None
        for k in keys:
            one = F.col(f"`{k}`") == F.col(f"{side}_{k}")
            on = one if on is None else on & one
        return on

    def _present(self, target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Keys of the source that the target has, as t_...: the target is only filtered by a source that is small
        enough to be sent to it (which Spark decides by size), and isn't shuffled then."""
        wanted = source.select(*(F.col(f"`{k}`").alias(f"s_{k}") for k in keys)).distinct()
        return target.join(wanted, self._same(keys, "s"), "left_semi").select(*(F.col(f"`{k}`").alias(f"t_{k}") for k in keys)).distinct()

    def merge_insert_only(self, source: DataFrame, keys: Sequence[str], where: Column | None = None) -> dict:
        """Insert source rows whose key the table lacks. Rows repeated within the source are all inserted; null keys
        match nothing. ``where`` narrows the target (on its columns), so that old files needn't be read."""
        if not self.exists():
            self.create(source.schema)
        target = self.read()
        if where is not None:
            target = target.where(where)
        if not self.manifest()["files"]:
            return self._insert(source, "MERGE INSERT")
        source = materialize(source)
        return self._insert(source.join(self._present(target, source, keys), self._same(keys, "t"), "left_anti"), "MERGE INSERT")

    def merge_upsert(self, source: DataFrame, keys: Sequence[str]) -> dict:
        """Replace rows whose key matches, whatever they hold; insert the rest. As merge_current otherwise."""
        return self.merge_current(source, keys, always=True)

    def merge_current(self, source: DataFrame, keys: Sequence[str], changed: Sequence[str] | None = None, always: bool = False) -> dict:
        """Replace rows whose key matches and whose ``changed`` columns differ (all, if none are named); insert the rest.

        The source needs one row per key (ValueError otherwise). Only files with a replaced row are rewritten.
        """
        if not self.exists():
            self.create(source.schema)
        m = self.manifest()
        source = materialize(source)
        if source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count():
            raise ValueError(f"several source rows for one key {list(keys)}")
        target = self.read()
        compared = [c for c in (changed or [c for c in source.columns if c not in keys]) if c in target.columns]
        marks = target.select(*(F.col(f"`{k}`").alias(f"t_{k}") for k in keys), *(F.col(f"`{c}`").alias(f"u_{c}") for c in compared), *([F.col("_metadata.file_path").alias("__file")] if m["files"] else [F.lit("").alias("__file")]))
        met = source.join(marks, self._same(keys, "t"))
        differs = F.lit(always)
        for c in compared:
            differs = differs | ~F.col(f"`{c}`").eqNullSafe(F.col(f"u_{c}"))
        updates = materialize(met.where(differs).select(*(F.col(f"`{c}`") for c in source.columns), "__file"))
        inserts = source.join(self._present(target, source, keys), self._same(keys, "t"), "left_anti")
        # file names: at most as many as the manifest lists already
        touched = {_spot(r["__file"]) for r in updates.select("__file").distinct().collect()}
        fresh = updates.drop("__file").distinct()
        out, kept_files = inserts.unionByName(fresh), m["files"]
        schema = self._evolved(m, source)
        if touched:
            gone = [f for f in m["files"] if _spot(f) in touched]
            kept_files = [f for f in m["files"] if _spot(f) not in touched]
            if len(gone) != len(touched):
                raise RuntimeError(f"files of {self.path} that its manifest doesn't list: {touched}")
            old = self.spark.read.schema(T.StructType.fromJson(m["schema"])).parquet(*gone)
            replaced = fresh.select(*(F.col(f"`{k}`").alias(f"n_{k}") for k in keys))
            out = old.join(replaced, self._same(keys, "n"), "left_anti").unionByName(out, allowMissingColumns=True)
        n_updates = fresh.count()
        n_inserts = inserts.count()
        metrics = {"inserted": n_inserts, "updated": n_updates, "deleted": 0}
        if n_updates or n_inserts:
            files, _ = self._write(out)
            self._commit(m["version"] + 1, "MERGE", metrics, schema, [*kept_files, *files])
        return metrics

    def delete_keys(self, gone: DataFrame, keys: Sequence[str]) -> dict:
        """Delete the rows with these keys; only files that hold one are rewritten."""
        m = self.manifest()
        target = self.read()
        metrics = {"inserted": 0, "updated": 0, "deleted": 0}
        if not m["files"]:
            return metrics
        marked = gone.select(*(F.col(f"`{k}`").alias(f"g_{k}") for k in keys)).distinct()
        hit = target.withColumn("__file", F.col("_metadata.file_path")).join(marked, self._same(keys, "g"), "left_semi").groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()
        if not hit:
            return metrics
        touched = {_spot(r["__file"]) for r in hit}
        metrics["deleted"] = sum(r["n"] for r in hit)
        old = self.spark.read.schema(target.schema).parquet(*(f for f in m["files"] if _spot(f) in touched))
        files, _ = self._write(old.join(marked, self._same(keys, "g"), "left_anti"))
        self._commit(m["version"] + 1, "DELETE", metrics, target.schema, [*(f for f in m["files"] if _spot(f) not in touched), *files])
        return metrics
