"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings that matter for these jobs; the cluster's own values win where set.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Medians keep one small buffer per key; allow many keys per task before
    # the aggregate turns to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}

#: Rows that one task of a fit takes: some 100 to 200 MB of sixty predictors.
TASK_ROWS = 200_000

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a session whose executor is the driver itself (``local`` or
    ``local[n]``) gets a temporary folder when the setting is missing; it is
    removed when the process ends.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="voucherlens-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's own intermediate tables."""
    return f"{shared_dir(spark)}/voucherlens-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for a table that several later joins or aggregates read: it is
    computed once, survives the loss of any executor, is read with pruned
    columns, and its size on disk is known to the optimizer. It stays until
    :func:`release`, since results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` wide rows in full rounds of the cluster's cores; 1 where its cores are enough."""
    cores = spark.sparkContext.defaultParallelism
    rounds = ceil(rows / TASK_ROWS / cores)
    return rounds * cores if rounds > 1 else 1


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, dealt evenly if they are more than its cores take at once.

    A scan packs files into tasks by their size on disk. Features take some thirty
    times as much in memory, so without this a task's part grows with the table.
    """
    tasks = tasks_for(df.sparkSession, rows)
    return df if tasks == 1 else df.repartition(tasks)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(conf).delete(where, True)


def discard(table: DataFrame) -> None:
    """Remove a table that :func:`written` made and that nothing reads any more."""
    spark = table.sparkSession
    known = _written.get(spark.sparkContext.applicationId, [])
    folders = {file.rsplit("/", 1)[0].split(":", 1)[-1] for file in table.inputFiles()}
    paths = [p for p in known if any(f.endswith(p.split(":", 1)[-1].lstrip("/")) for f in folders)]
    _delete(spark, paths)
    known[:] = [p for p in known if p not in paths]


def release(spark: SparkSession) -> None:
    """Remove the tables that :func:`written` made in this application.

    Call it when the results that read them have been stored.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    if not paths:
        return
    _delete(spark, paths)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    # The run folder goes too, unless something else lies in it.
    top = hadoop.Path(run_dir(spark))
    system = top.getFileSystem(conf)
    if system.exists(top) and not list(system.listStatus(top)):
        system.delete(top, False)
