"""Append-only JSON line files, one folder or file per topic, as a streaming source ("jsonl_tail").

Offsets are bytes per file, so a batch reads just what was appended, and a restart reads the same range again. A batch
is split into ranges of at most ``split_bytes``; a range owns the lines that begin in it.

With ``verify`` the offset also keeps a SHA-256 of all bytes up to it: a file that shrank, vanished or was changed
before the committed offset fails the query instead of yielding wrong rows. That hash is carried forward from the bytes
that are new, and checked against the old bytes only when a query starts.

Defined results: blank lines are no records; a last line without line end waits until it is complete; lines of any
length are whole; files that don't exist yet are empty; topic is the file's name without its extension.
"""

from __future__ import annotations

import datetime
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = "raw_payload string, topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp_ntz"


_MARKS = 64


class TamperedSource(RuntimeError):
    """A file differs from what was committed."""


class Range(InputPartition):
    def __init__(self, path: str, topic: str, start: int, end: int, limit: int):
        super().__init__((path, start, end))
        self.path, self.topic, self.start, self.end, self.limit = path, topic, start, end, limit


def _complete_end(path: str, start: int, most: int, block: int = 1 << 20) -> int:
    """The end of the last complete line within ``most`` bytes from start; if the first line is longer, its end."""
    size = os.path.getsize(path)
    limit = min(size, start + most)
    with open(path, "rb") as f:
        at = limit
        while at > start:
            low = max(start, at - block)
            f.seek(low)
            newline = f.read(at - low).rfind(b"\n")
            if newline >= 0:
                return low + newline + 1
            at = low
        f.seek(limit)
        while part := f.read(block):
            newline = part.find(b"\n")
            if newline >= 0:
                return f.tell() - len(part) + newline + 1
    return start


def _digest(path: str, end: int, start: int = 0, before: str | None = None) -> str:
    """Chained SHA-256: of the earlier digest (hex) and the new bytes."""
    h = hashlib.sha256((before or "").encode())
    with open(path, "rb") as f:
        f.seek(start)
        left = end - start
        while left > 0 and (block := f.read(min(1 << 20, left))):
            h.update(block)
            left -= len(block)
    return h.hexdigest()


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.verify = options.get("verify", "false") == "true"
        self.most = int(options.get("max_bytes_per_trigger", 256 << 20))
        self.split = int(options.get("split_bytes", 32 << 20))
        self._at: dict | None = None

    def _files(self) -> dict[str, str]:
        if not os.path.isdir(self.folder):
            return {}
        return {n.rsplit(".", 1)[0]: os.path.join(self.folder, n) for n in sorted(os.listdir(self.folder)) if n.endswith(".jsonl")}

    def initialOffset(self) -> dict:
        return {}

    def _check(self, offset: dict) -> None:
        files = self._files()
        for topic, (end, *chain) in offset.items():
            path = files.get(topic)
            if path is None:
                raise TamperedSource(f"{topic}: committed file is missing")
            if os.path.getsize(path) < end:
                raise TamperedSource(f"{topic}: file is shorter than committed")
            if self.verify and chain:
                digest, before = None, 0
                for mark in chain[0]:
                    digest = _digest(path, mark[0], before, digest)
                    before = mark[0]
                    if digest != mark[1]:
                        raise TamperedSource(f"{topic}: bytes before {mark[0]} changed")

    def latestOffset(self) -> dict:
        done = self._at or {}
        out = dict(done)
        for topic, path in self._files().items():
            entry = done.get(topic, [0, []])
            start, marks = entry[0], entry[1] if len(entry) > 1 else []
            if os.path.getsize(path) < start:
                raise TamperedSource(f"{topic}: file is shorter than committed")
            end = _complete_end(path, start, self.most)
            if end > start:
                if self.verify:
                    if len(marks) < _MARKS:
                        marks = [*marks, [end, _digest(path, end, start, marks[-1][1] if marks else None)]]
                    else:  # one mark instead of many keeps the offset short
                        marks = [[end, _digest(path, end)]]
                out[topic] = [end, marks]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self._at is None and start:
            self._check(start)
        self._at = end
        files, out = self._files(), []
        for topic, (stop, *_) in end.items():
            begin = start[topic][0] if topic in start else 0
            if topic not in files:
                raise TamperedSource(f"{topic}: committed file is missing")
            for s in range(begin, stop, self.split):
                out.append(Range(files[topic], topic, s, min(s + self.split, stop), stop))
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        at = datetime.datetime.fromtimestamp(os.path.getmtime(part.path), datetime.timezone.utc).replace(tzinfo=None)
        with open(part.path, "rb") as f:
            f.seek(part.start)
            if part.start:
                f.seek(part.start - 1)
                f.readline()  # the rest of a line that began earlier (nothing, if a line begins here)
            place = f.tell()
            while place < part.end and (line := f.readline()):
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text.strip():
                    yield text, part.topic, 0, place, at
                place = f.tell()


class JsonlTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(JsonlTail)
