"""Runs and their operation: a ledger of states, metrics text, an incident report, snapshot checks, profiles."""

from __future__ import annotations

import datetime
import json
import os
import re
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources.versioned import VersionedTable

RUNNING, COMMITTED, SUCCESS, FAILED, INTERRUPTED, RECOVERED = "RUNNING", "COMMITTED", "SUCCESS", "FAILED", "INTERRUPTED", "RECOVERED"
_NEXT = {None: {RUNNING}, RUNNING: {COMMITTED, FAILED, INTERRUPTED}, COMMITTED: {SUCCESS, FAILED, RECOVERED}}
_LEDGER = (
    "run_id string, pipeline_name string, status string, records_read long, records_written long, records_rejected long, records_duplicate long, records_late long, "
    "started_at timestamp_ntz, ended_at timestamp_ntz, message string"
)
COUNTS = ("records_read", "records_written", "records_rejected", "records_duplicate", "records_late")


class Ledger:
    """One row per run. States: RUNNING, COMMITTED, SUCCESS or FAILED; a start marks what earlier runs left behind."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)
        self.table.create(spark.createDataFrame([], _LEDGER).schema)

    def _put(self, rows: DataFrame) -> None:
        self.table.merge_current(rows, ["run_id"])

    def start(self, run_id: str, pipeline: str, at) -> None:
        """RUNNING rows of others become INTERRUPTED, COMMITTED ones RECOVERED: there is one writer at a time."""
        old = self.table.read().where(F.col("status").isin(RUNNING, COMMITTED))
        self._put(old.withColumn("status", F.when(F.col("status") == RUNNING, INTERRUPTED).otherwise(RECOVERED)).withColumn("ended_at", F.lit(at).cast("timestamp_ntz")))
        self._put(self.spark.createDataFrame([(run_id, pipeline, RUNNING, 0, 0, 0, 0, 0, at, None, None)], _LEDGER))

    def move(self, run_id: str, status: str, at=None, message: str | None = None, **counts: int) -> None:
        row = self.table.read().where(F.col("run_id") == run_id)
        now = row.first()
        if status not in _NEXT.get(now["status"] if now else None, set()):
            raise ValueError(f"run {run_id}: {now['status'] if now else 'unknown'} can't become {status}")
        new = now.asDict() | counts | {"status": status, "ended_at": at, "message": message}
        self._put(self.spark.createDataFrame([tuple(new[c] for c in row.columns)], _LEDGER))

    def read(self) -> DataFrame:
        return self.table.read()


def metrics_text(run: dict, prefix: str = "tidemill", alerts: int | None = None) -> str:
    """Prometheus text of one run: counts by status, the three rates, failure, duration (if known) and number of alerts."""
    read = run["records_read"]
    lines = [f"# TYPE {prefix}_records_total gauge"]
    lines += [f'{prefix}_records_total{{status="{c.removeprefix("records_")}"}} {run[c]}' for c in COUNTS]
    for name, c in (("duplicate_rate", "records_duplicate"), ("rejection_rate", "records_rejected"), ("late_event_rate", "records_late")):
        lines += [f"# TYPE {prefix}_{name} gauge", f"{prefix}_{name} {run[c] / read if read else 0.0}"]
    gauges = {"pipeline_failed": int(run.get("status", SUCCESS) != SUCCESS), "pipeline_duration_seconds": run.get("duration_seconds"), "alerts": alerts}
    for name, value in gauges.items():
        if value is not None:
            lines += [f"# TYPE {prefix}_{name} gauge", f"{prefix}_{name} {value}"]
    return "\n".join(lines) + "\n"


def publish(folder: str, run: dict, alerts: Iterable[dict]) -> None:
    """The metrics files of a run: metrics.prom, latest.json (run and alerts), alerts.jsonl (one line more per alert) and incident.txt."""
    alerts = list(alerts)
    write_atomic(f"{folder}/metrics.prom", metrics_text(run, alerts=len(alerts)))
    write_atomic(f"{folder}/latest.json", json.dumps({"run": run, "alerts": alerts}, sort_keys=True, allow_nan=False, default=str))
    write_atomic(f"{folder}/incident.txt", incident_report(run, alerts))
    if alerts:
        with open(f"{folder}/alerts.jsonl", "a", encoding="utf-8") as f:
            f.writelines(json.dumps(a, sort_keys=True, allow_nan=False, default=str) + "\n" for a in alerts)


#: What each alert points to, and what to do about it.
_ADVICE = {
    "pipeline_failure": ("the run did not end well; its message in the ledger has the error", "mend the error and run again: committed input is not read twice"),
    "duplicate_rate": ("messages were sent again, by a producer or after a restart", "look at the producer's retries; copies are left out of Silver meanwhile"),
    "rejection_rate": ("payloads break the event contract", "look at the quarantine by error type and agree on the contract with the sender"),
    "late_event_rate": ("events arrive more than 30 minutes after they happened", "look at the sender's clock and at the backlog of the transport"),
}


def incident_report(run: dict, alerts: Iterable[dict]) -> str:
    """What happened, from the alerts of one run: the same text for the same numbers."""
    found = sorted(alerts, key=lambda a: (a["severity"] != "critical", a["metric"]))
    if not found:
        return f"Run {run['run_id']}: no alert.\n"
    lines = [f"Run {run['run_id']} ({run['status']}): {len(found)} alert(s)."]
    for a in found:
        lines.append(f"- {a['severity']}: {a['metric']} is {a['value']:.4f}, above {a['threshold']:.4f}")
        if a["metric"] in _ADVICE:
            lines += [f"  cause: {_ADVICE[a['metric']][0]}", f"  action: {_ADVICE[a['metric']][1]}"]
    lines.append(f"Read {run['records_read']}, written {run['records_written']}, duplicate {run['records_duplicate']}, rejected {run['records_rejected']}, late {run['records_late']}.")
    return "\n".join(lines) + "\n"


def balanced(run: dict) -> bool:
    """Every record read went to exactly one place."""
    return run["records_read"] == sum(run[c] for c in COUNTS[1:])


def write_atomic(path: str, text: str) -> None:
    """A small local file, replaced as a whole: readers see the old or the new text."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, 0o644)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


# reconciliation and snapshots ----------------------------------------------------------------------------------------


class Unreconciled(ValueError):
    """Layers that should agree don't."""


def reconcile_or_fail(row: dict, equal: Iterable[tuple[str, str]], tolerance: float = 0.0) -> None:
    """Compare named totals in pairs. Totals must be finite non-negative numbers; booleans and texts are no numbers."""
    for a, b in equal:
        for name in (a, b):
            value = row.get(name)
            if isinstance(value, (bool, str)) or value is None or not (0 <= float(value) < float("inf")):
                raise Unreconciled(f"{name} is {value!r}")
        if abs(float(row[a]) - float(row[b])) > tolerance:
            raise Unreconciled(f"{a} is {row[a]}, {b} is {row[b]}")


#: Parts of a dashboard document that may be there beside the four that must.
_MORE = {"customers", "inventory", "eventRate", "reconciliation", "metadata"}


def snapshot(
    kpis: DataFrame, daily: DataFrame, countries: DataFrame, products: DataFrame, customers: DataFrame | None = None, inventory: DataFrame | None = None,
    event_rate: DataFrame | None = None, reconciliation: dict | None = None, metadata: dict | None = None,
) -> str:
    """The dashboard document as JSON: reports of bounded size only (days, minutes of a window, top lists), each read as one row."""
    rows = lambda f, order: f.agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in f.columns if c != order])))).alias("j")).first()["j"]
    parts = {"kpis": kpis.select(F.to_json(F.struct("*")).alias("j")).first()["j"], "dailySales": rows(daily, "order_date"), "countries": rows(countries, "country"), "products": rows(products, "product_id")}
    for name, frame, order in (("customers", customers, "customer_id"), ("inventory", inventory, "product_id"), ("eventRate", event_rate, "minute")):
        if frame is not None:
            parts[name] = rows(frame, order)
    made = {k: json.loads(v) for k, v in parts.items()} | {k: v for k, v in (("reconciliation", reconciliation), ("metadata", metadata)) if v is not None}
    return json.dumps(made, sort_keys=True, allow_nan=False, default=str)


def age_label(then: datetime.datetime, now: datetime.datetime) -> str:
    """How old a snapshot is, in words: whole minutes, hours or days; the future counts as just now."""
    minutes = int((now - then).total_seconds() // 60)
    for size, name in ((1440, "day"), (60, "hour"), (1, "minute")):
        if minutes >= size:
            n = minutes // size
            return f"{n} {name}{'s' if n > 1 else ''} ago"
    return "just now"


def validate_snapshot(document: str, cents: float = 0.005) -> list[str]:
    """What is wrong with a snapshot: unknown or missing parts, days out of order, sums that differ from the totals."""
    data = json.loads(document)
    wanted = {"kpis", "dailySales", "countries", "products"}
    wrong = [f"missing {k}" for k in sorted(wanted - data.keys())] + [f"unknown {k}" for k in sorted(data.keys() - wanted - _MORE)]
    if wrong:
        return wrong
    days = [d["order_date"] for d in data["dailySales"]]
    if any(a >= b for a, b in zip(days, days[1:], strict=False)):
        wrong.append("days are not strictly increasing")
    for name in ("orders", "units", "revenue"):
        if abs(sum(float(d[name]) for d in data["dailySales"]) - float(data["kpis"][name])) > cents:
            wrong.append(f"sum of daily {name} differs from its total")
    orders, average = data["kpis"]["orders"], float(data["kpis"]["average_order_value"])
    if orders and abs(average - float(data["kpis"]["revenue"]) / orders) > cents:
        wrong.append("average order value differs from revenue over orders")
    return wrong


def days_in_order(sales: DataFrame) -> DataFrame:
    """Days that don't come strictly after the one before them (repeats); empty if all is well."""
    before = Window.partitionBy(F.date_trunc("month", "order_date")).orderBy("order_date")
    return sales.select("order_date", F.lag("order_date").over(before).alias("previous")).where(F.col("previous") >= F.col("order_date"))


# settings ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """Volumes of a run."""

    name: str
    events: int
    batch_size: int = 5000
    limits: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def parse(values: dict) -> Profile:
        """Checked settings: a plain name, positive numbers, batches no larger than the whole."""
        name = values.get("name", "")
        if not re.fullmatch(r"[a-z][a-z0-9_-]{0,40}", name):
            raise ValueError(f"profile name {name!r}")
        made = Profile(name, values["events"], values.get("batch_size", 5000), dict(values.get("limits", {})))
        for key, value in {"events": made.events, "batch_size": made.batch_size, **made.limits}.items():
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError(f"{key} must be a positive integer")
        if made.batch_size > made.events:
            raise ValueError("batch_size exceeds events")
        return made
