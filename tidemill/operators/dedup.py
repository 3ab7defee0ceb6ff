"""Exactly one copy of each message, without shuffling payloads.

Only the identifier, the delivery order and the position of the row (file and row number, from the Parquet reader)
are shuffled. They select one winner per identifier; the other rows become deletion vectors: compressed lists of row
numbers, one per file and 32,768 rows, in the shared folder. Wide rows are then read where they lie: each scan task
opens the vectors of the files that it reads, range by range, and drops the rows they list. Nothing is broadcast but the
most repeated identifiers, at most 1/HOT of them, whose rows are salted so that no task gets all rows of one message.

Defined results: the first delivery wins (smallest order columns, nulls last; then file and row number); a row without
a readable identifier is kept, since it can't be told to be a copy; an empty table gives no rows. No helper column is
added to the table, so its columns may have any names.

The vectors are opened by the Python workers through the file systems of pyarrow: the shared folder must be one that
it knows too (a mounted folder, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import materialize, prepare, work_path

#: Share of all repeated rows from which on a message is salted.
HOT, SALTS = "0.001", 64
#: Losers per folder of vectors: a folder is sorted by file and range, so a task opens a few row groups of it.
PER_FOLDER = 4_000_000
#: Ranges of 32,768 rows that a task keeps at once.
WINDOW = 64


def positions(source: DataFrame, identifier: Column, order: Sequence[str] = ()) -> DataFrame:
    """message, the order columns as o0, o1, ..., file (hash of its path) and row: all that is shuffled."""
    return source.select(
        identifier.alias("message"),
        *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)),
        F.xxhash64("_metadata.file_path").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    ).where(F.col("message").isNotNull())


def deliveries(narrow: DataFrame) -> DataFrame:
    """Per message: n rows, and as winner its first delivery. Repeats are combined before the shuffle."""
    order = [c for c in narrow.columns if c.startswith("o")]
    keyed = [x for c in order for x in (F.col(c).isNull().alias(f"{c}n"), F.col(c).alias(c))]
    return narrow.groupBy("message").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*keyed, F.col("__file").alias("f"), F.col("__row").alias("r"))).alias("winner")
    )


def losers(narrow: DataFrame) -> tuple[DataFrame, int]:
    """__file and __row of all rows but the winners, and how many there are."""
    many = materialize(deliveries(narrow).where(F.col("n") >= 2).select("message", "n", F.col("winner.f").alias("wf"), F.col("winner.r").alias("wr")))
    rows, messages = many.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hot = many.where(F.col("n") >= F.lit(Decimal(HOT)) * rows)
    salted = hot.select("message", "wf", "wr", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    others = many.join(F.broadcast(hot.select("message")), "message", "left_anti").select("message", "wf", "wr", F.lit(0).alias("__salt"))
    is_hot = F.broadcast(hot.select("message", F.lit(True).alias("__hot")))
    spread = narrow.select("message", "__file", "__row").join(is_hot, "message", "left")
    spread = spread.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("__file", "__row"), F.lit(SALTS)).cast("int")).otherwise(0))
    met = spread.join(salted.unionByName(others), ["message", "__salt"])
    return met.where(~((F.col("__file") == F.col("wf")) & (F.col("__row") == F.col("wr")))).select("__file", "__row"), rows - messages


def deletion_vectors(spark: SparkSession, narrow: DataFrame) -> tuple[str, int]:
    """Write the vectors: file, bucket (of 32,768 rows) and the sorted 16-bit places in it. Returns their folder and the
    number of folders below it. A bucket has at most 32,768 places whatever the data."""
    gone, n = losers(narrow)
    folders = 1 + n // PER_FOLDER
    place = F.col("__row") + 1
    parted = gone.select(
        F.pmod(F.col("__file"), F.lit(folders)).alias("folder"), F.col("__file").alias("file"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).cast("short").alias("spot")
    ).repartition(int(folders), "folder")
    packed = parted.groupBy("folder", "file", "bucket").agg(F.array_sort(F.collect_list("spot")).alias("spots"))
    path = work_path(spark, "vectors")
    packed.sortWithinPartitions("folder", "file", "bucket").write.partitionBy("folder").parquet(path)
    return path, folders


def _open(path: str, folder: int, file: int, low: int, high: int) -> pa.Table | None:
    """The vectors of one file between two buckets, by row groups that can hold them."""
    import pyarrow.fs
    import pyarrow.parquet

    system, root = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", path) if path.startswith("file:") else path))
    at = f"{root}/folder={folder}"
    if system.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
        return None
    wanted = [("file", "=", file), ("bucket", ">=", low), ("bucket", "<", high)]
    return pyarrow.parquet.read_table(at, columns=["bucket", "spots"], filters=wanted, filesystem=system, partitioning=None)


def is_marked(path: str, folders: int) -> Column:
    """Whether the deletion vectors list the row that is read. A task keeps the window of one file that it is in."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # file, first bucket of the window, and the sorted row numbers listed in it
        held: tuple[int, int, np.ndarray] = (0, -1, np.empty(0, dtype=np.int64))

        def window(file: int, bucket: int) -> np.ndarray:
            nonlocal held
            low = (bucket - 1) // WINDOW * WINDOW + 1
            if held[:2] != (file, low):
                found = _open(path, file % folders, file, low, low + WINDOW)
                rows = np.empty(0, dtype=np.int64)
                if found is not None and found.num_rows:
                    spots = found["spots"].combine_chunks()
                    sizes = np.diff(spots.offsets.to_numpy())
                    rows = np.sort(np.repeat((found["bucket"].to_numpy() - 1) * 32_768, sizes) + spots.flatten().to_numpy().astype(np.int64))
                held = (file, low, rows)
            return held[2]

        for file, row in batches:
            files, rows = file.to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)
            out = np.zeros(len(rows), dtype=bool)
            # rows come file by file in order, so a batch has few stretches of one file and window
            stretch = np.flatnonzero(np.diff(files, prepend=~files[:1]).astype(bool) | np.diff(rows // (32_768 * WINDOW), prepend=-1).astype(bool)) if len(rows) else []
            for start, end in zip(stretch, [*stretch[1:], len(rows)], strict=True):
                listed = window(int(files[start]), int(rows[start]) // 32_768 + 1)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, rows[start:end]), len(listed) - 1)
                    out[start:end] = listed[at] == rows[start:end]
            yield pa.array(out)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "boolean")(F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))


def _vectors(spark: SparkSession, path: str | Sequence[str], identifier: Callable[[DataFrame], Column], order: Sequence[str]) -> tuple[DataFrame, Column]:
    """A Parquet table and the mark of its rows, from the vectors built for it."""
    source = prepare(spark).read.parquet(*([path] if isinstance(path, str) else path))
    return source, is_marked(*deletion_vectors(spark, positions(source, identifier(source), order)))


def keep_first(spark: SparkSession, path: str | Sequence[str], identifier: Callable[[DataFrame], Column], order: Sequence[str] = ()) -> DataFrame:
    """All columns of a Parquet table with one row per message."""
    source, marked = _vectors(spark, path, identifier, order)
    return source.where(~marked)


def marked_messages(spark: SparkSession, path: str | Sequence[str], identifier: Callable[[DataFrame], Column], order: Sequence[str] = ()) -> DataFrame:
    """The messages of a Parquet table of which keep_first leaves out rows: message, once each."""
    source, marked = _vectors(spark, path, identifier, order)
    return source.where(marked).select(identifier(source).alias("message")).distinct()


def dedupe_rows(frame: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """For frames that aren't Parquet files: the first row per key under a total order, deterministic on ties.

    The row travels with its key here; map-side combination keeps a hot key to one row per task.
    """
    struct = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*(F.col(f"`{c}`") for c in frame.columns)).alias("row"))
    return frame.groupBy(*key).agg(F.min(struct).alias("__first")).select("__first.row.*")
