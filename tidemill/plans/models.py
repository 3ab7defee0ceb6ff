"""Models and how each is kept: as a view, a table, an incremental table with a key, or a snapshot with history.

Models are built in the order given, from sources and earlier models. A view is worked out when it is read; a table is
replaced; of an incremental table only rows that differ from what is stored are merged by key, unless a full refresh is
asked for; a snapshot closes changed versions and opens new ones. Unchanged incremental tables and snapshots get no new
version. All tables and deltas are computed before the first is committed, so a failing model leaves all as they were.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import history
from tidemill.session import materialize
from tidemill.sources.versioned import VersionedTable

VIEW, TABLE, INCREMENTAL, SNAPSHOT = "view", "table", "incremental", "snapshot"


@dataclass(frozen=True)
class Model:
    name: str
    kind: str
    build: Callable[[Mapping[str, DataFrame]], DataFrame]
    key: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in (VIEW, TABLE, INCREMENTAL, SNAPSHOT):
            raise ValueError(f"model {self.name}: kind {self.kind}")
        if self.kind in (INCREMENTAL, SNAPSHOT) and not self.key:
            raise ValueError(f"model {self.name} needs a key")


def build(spark: SparkSession, root: str, models: Sequence[Model], sources: Mapping[str, DataFrame], at: datetime.datetime | None = None, full_refresh: bool = False) -> dict[str, dict]:
    """Build all models below a folder; returns the metrics per kept model. ``at`` is the time of snapshots."""
    frames, due = dict(sources), []
    for m in models:
        made = m.build(frames)
        if m.kind == VIEW:
            frames[m.name] = made
            made.createOrReplaceTempView(m.name)
            continue
        frames[m.name] = made = materialize(made)
        table = VersionedTable(spark, f"{root.rstrip('/')}/{m.name}")
        if m.kind == INCREMENTAL and table.exists() and not full_refresh:
            stored = table.read()
            due.append((m, table, materialize(made.subtract(stored.select(*made.columns)))))
        else:
            due.append((m, table, made))
    metrics = {}
    for m, table, rows in due:
        if m.kind == SNAPSHOT:
            metrics[m.name] = history.merge_snapshot(table, rows, m.key, m.attributes, at or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))
        elif m.kind == INCREMENTAL and table.exists() and not full_refresh:
            metrics[m.name] = table.merge_current(rows, m.key)
        else:
            metrics[m.name] = table.overwrite(rows)
    return metrics
