"""Landing of files: archive gates, spreadsheets, typed text files, immutable deliveries, exports."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.parse import INVOICE_FIELDS

_LINES = ", ".join(["member string", "row_number long", *(f"{c} string" for c in INVOICE_FIELDS)])


class RejectedArchive(ValueError):
    """An archive that fails a gate."""


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema, with the file each row came from. Columns missing in a line are null."""
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("source_file"))


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Invoice lines as texts with a header; a byte order mark is skipped, quoted line breaks are kept."""
    schema = ", ".join(f"{c} string" for c in INVOICE_FIELDS)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def archives(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """path, length, sha256 and content of ZIP files. An empty one or one over the limit raises RejectedArchive before any is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    # names and lengths come from the listing: no content is read here. Spark lists empty files but never scans them
    jvm = spark.sparkContext._jvm
    sizes = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)).toString(): 0 for name in found.inputFiles()}
    sizes |= {r.path: r.length for r in found.select("path", "length").collect()}
    wrong = [f"{name}: size is {size}" for name, size in sorted(sizes.items()) if not 0 < size <= most_bytes]
    if wrong:
        raise RejectedArchive(f"not 1 to {most_bytes} bytes: {'; '.join(wrong)}")
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet of an XLSX file as texts; only the standard library is needed."""
    from xml.etree import ElementTree

    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if tag(t) == "t"))
        sheet = sorted(n for n in book.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))[0]
        with book.open(sheet) as xml:
            for _, row in ElementTree.iterparse(xml):
                if tag(row) != "row":
                    continue
                cells: list[str | None] = []
                for cell in row:
                    letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                    at = 0
                    for c in letters:
                        at = at * 26 + ord(c) - 64
                    value = "".join(t.text or "" for t in cell.iter() if tag(t) in ("v", "t"))
                    cells += [None] * (max(at, len(cells) + 1) - 1 - len(cells))
                    cells.append(shared[int(value)] if cell.get("t") == "s" else value)
                yield cells
                row.clear()


def invoice_lines(found: DataFrame, sha256: str | None = None, member: str = "*.xlsx") -> DataFrame:
    """Invoice lines of spreadsheets inside ZIP files: member, row_number and the eight fields as texts.

    One task per archive. An archive whose hash, member or columns aren't as expected fails the job (RejectedArchive).
    """
    import fnmatch

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if sha256 is not None and row.sha256 != sha256:
                    raise RejectedArchive(f"{row.path}: hash is {row.sha256}")
                with zipfile.ZipFile(io.BytesIO(row.content)) as z:
                    names = [n for n in z.namelist() if fnmatch.fnmatch(n.lower(), member)]
                    if len(names) != 1:
                        raise RejectedArchive(f"{row.path}: {len(names)} members match {member}")
                    rows = _sheet_rows(z.read(names[0]))
                    head = next(rows, [])
                    if [c for c in head if c] != list(INVOICE_FIELDS):
                        raise RejectedArchive(f"{row.path}: columns are {head}")
                    block: list[tuple] = []
                    for n, cells in enumerate(rows, 1):
                        block.append((names[0], n, *(cells + [None] * 8)[:8]))
                        if len(block) == 10_000:
                            yield pd.DataFrame(block, columns=["member", "row_number", *INVOICE_FIELDS])
                            block = []
                    yield pd.DataFrame(block, columns=["member", "row_number", *INVOICE_FIELDS])

    return found.mapInPandas(unpack, _LINES)


# deliveries and exports ----------------------------------------------------------------------------------------------


class Delivery:
    """An immutable set of tables below one folder; its manifest is written last and makes it complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = lambda name: (p := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))

    def _exists(self, name: str) -> bool:
        path, fs = self._fs(name)
        return fs.exists(path)

    def write(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Rows per table. A complete delivery is reused as it is; a partial one is refused (FileExistsError)."""
        if self._exists("_manifest"):
            rows = self.spark.read.json(f"{self.path}/_manifest").first().asDict()
            return {name: rows[name] for name in tables}
        if any(self._exists(name) for name in tables):
            raise FileExistsError(f"{self.path} holds a partial delivery")
        rows = {}
        for name, frame in tables.items():
            frame.write.mode("error").json(f"{self.path}/{name}")
            rows[name] = self.spark.read.schema(frame.schema).json(f"{self.path}/{name}").count()
        self.spark.createDataFrame([(json.dumps(rows),)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/_manifest")
        return rows


def export_ordered(frame: DataFrame, path: str, by: Sequence[str]) -> None:
    """JSON lines in a total order: range-partitioned files, each sorted, whose names sort like their rows."""
    frame.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").json(path)


def append_lines(frame: DataFrame, path: str) -> None:
    """raw_payload lines appended below one folder per topic."""
    frame.select(F.col("topic"), F.col("raw_payload").alias("value")).write.mode("append").partitionBy("topic").text(path)
