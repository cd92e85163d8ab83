"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Written tables that nothing has deleted yet, of all threads.
_written: set[str] = set()
#: Those of the innermost scope of this thread (or other context).
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_lock = threading.Lock()
#: Writes that go on now, and what the clean-up option was before the first of them.
_writes: dict[str, object] = {"n": 0, "before": None}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a fresh temporary folder; on a cluster that
    would be a folder of one machine, so there the missing setting is an error.
    """
    found = spark.conf.get(_SETTING, None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexshoal-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(_SETTING, own)
    return own


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, where neither their working directory nor PYTHONPATH has it."""
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="lexshoal-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under the application's own folder."""
    return f"{shared_dir(spark)}/lexshoal/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def plain_path(path: str) -> str:
    """A path as programs open it, for the file readers and writers that do not go through Spark."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not a path that all executors can open")
    return parts.path if parts.scheme else path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _tables() -> list[str]:
    """The tables of this thread's innermost scope."""
    found = _scope.get()
    if found is None:
        found = []
        _scope.set(found)
    return found


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes at its end the tables written inside it by this thread, but those whose names begin with one of ``keep``.

    For steps whose results are written tables themselves: what a step has read goes with it. Kept
    tables pass to the scope around it. Tables of other threads stay.
    """
    outer, made = _tables(), []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        kept = [path for path in made if path.rpartition("/")[2].rpartition("-")[0] in keep]
        outer += kept
        gone = [path for path in made if path not in kept]
        _written.difference_update(gone)
        _delete(spark, gone)


def release(spark: SparkSession) -> None:
    """Delete the tables that this thread has written to the shared folder, in the scope that it is in. Results not yet read are lost."""
    tables = _tables()
    gone, tables[:] = list(tables), []
    _written.difference_update(gone)
    _delete(spark, gone)


def _at_exit() -> None:
    """What is left goes with the process, while its session lives."""
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            _delete(spark, list(_written))
        except Exception:  # noqa: BLE001  the session may have ended already
            _written.clear()


atexit.register(_at_exit)


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries go at their end. The option is the session's: the last of several threads puts it back."""
    with _lock:
        if not _writes["n"]:
            _writes["before"] = spark.conf.get(_CLEAN_UP, "false")
            spark.conf.set(_CLEAN_UP, "true")
        _writes["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _writes["n"] -= 1
            if not _writes["n"]:
                spark.conf.set(_CLEAN_UP, _writes["before"])


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that read the table, not the stages that
    made it. Shuffle files of the stages go as soon as the table stands, so a job of many steps holds
    those of one step at a time. Tables stay until ``scratch``, ``release`` or the end of the process.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _tables().append(path)
    _written.add(path)
    with _cleaned_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by the directory that holds them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
