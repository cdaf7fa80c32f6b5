"""Session-level helpers: checkpoint folders, worker imports, table reads."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REPO_ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all tasks run in this process (unit
    tests, a laptop) a temporary folder is set, since checkpoint() would
    otherwise fail; on a cluster it would be one that executors don't share.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="meshlight-checkpoint-")
    sc.setCheckpointDir(own)
    return own


def session_folder(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables, removed when the driver ends."""
    sc = spark.sparkContext
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/meshlight-{sc.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before; nothing is left to do then
        pass


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again, which cuts its lineage.

    Unlike a checkpointed plan, which carries the estimated size of the plan
    before on (a product over all joins of a loop), a table has its real size.
    The shuffles of the write are deleted with it, not when the driver happens to collect its garbage.
    ``by``: last columns that name the table's folders, so that one can be read alone.
    """
    path = f"{session_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes a table that cut() wrote and that nothing reads any more."""
    for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
        _remove(table.sparkSession, file)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers started later import this package from the repository."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, REPO_ROOT])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow(); after a task its worker, which stays for others, gives free memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
