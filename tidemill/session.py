"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tidemill

# Python functions travel to executors by value: these need no copy of the package on their path.
cloudpickle.register_pickle_by_value(tidemill)

#: Settings that results depend on; they may be set on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
}


#: Folders of sessions that name none, by application.
_TEMPORARY: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; sizes and memory are left to the cluster."""
    for name, value in RUNTIME.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(app: str = "tidemill", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A single-machine session, for tests and bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or another one given to setCheckpointDir.

    Only where neither is set and all runs on one machine (tests) is a temporary folder made, which is removed at exit;
    on a cluster that is an error, since executors would write to their own disks.
    """
    named, given = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    plain = lambda path: re.sub("^file:/*", "/", path)
    # Spark makes a folder of its own below the named one; a folder elsewhere was given by hand
    found = named if named and (not given or plain(given).startswith(plain(named))) else given
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _TEMPORARY:
        _TEMPORARY[app] = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, _TEMPORARY[app], ignore_errors=True)
    return f"file://{_TEMPORARY[app]}"


def _own(path: str) -> str:
    """On a local file system, what this process wrote goes when it ends. Elsewhere the folder's owner cleans it."""
    local = path.removeprefix("file://")
    if local.startswith("/"):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return path


def work_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder."""
    return _own(f"{shared_dir(spark)}/tidemill/{kind}/{uuid.uuid4().hex}")


def materialize(frame: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it back.

    Unlike a cached block, a lost executor doesn't take it along, and values made by
    monotonically_increasing_id stay what they were.
    """
    spark = frame.sparkSession
    path = _own(f"{shared_dir(spark)}/tidemill/{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
