"""Session helpers: shipping the package to executors and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
REPO_DIR = os.path.dirname(PACKAGE_DIR)


class _Made(threading.local):
    """Paths of the tables that this thread has written, for those who remove them in the end."""

    def __init__(self):
        self.paths: list[str] = []


MADE = _Made()


class Stash(NamedTuple):
    """A table written to the shared folder: its DataFrame and its path."""

    df: DataFrame
    path: str


def ship(spark: SparkSession, batch_bytes: int = 4 << 20) -> None:
    """Make the package importable on executors, and bound Arrow batches by bytes as well as rows.

    Both bounds are settings of the session that stay set, as plans read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    if REPO_DIR in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    done = getattr(ship, "done", set())
    if sc.applicationId in done:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for top, _, names in os.walk(PACKAGE_DIR):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.relpath(full, REPO_DIR))
    sc.addPyFile(target)
    ship.done = done | {sc.applicationId}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``. Only a local master may go without: there one
    temporary folder per application stands in, as driver and executors are one process.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    roots = getattr(shared_root, "roots", {})
    app = spark.sparkContext.applicationId
    if app not in roots:
        roots[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-shared-")
        shared_root.roots = roots
    return roots[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> Stash:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of lineage that
    survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    MADE.paths.append(path)
    return Stash(df.sparkSession.read.schema(df.schema).parquet(path), path)


def discard(spark: SparkSession, *tables: Stash | str) -> None:
    """Remove stashed tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.path)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


_ONCE: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, inputs: list[str], make):
    """What ``make()`` gives, made once an application for each state (time and size) of its input paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def state(path: str) -> tuple:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        return path, fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()

    key = (spark.sparkContext.applicationId, name, *map(state, inputs))
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


def kept(spark: SparkSession, name: str, inputs: list[str], make) -> DataFrame:
    """The table ``make()``, written once for each state of its inputs and read by every query that needs it."""
    return once(spark, name, inputs, lambda: stash(make(), name).df)
