"""Where jobs keep tables that cut lineage: the folder all executors share, as named by the session."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and all runs in one process, as in tests, a
    folder of this process, removed at its end. On a cluster the setting must name a folder all executors share."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named:
        # sc.getCheckpointDir() would also give a folder some caller set for RDDs.
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, own, True)
        named = "file://" + own
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_place(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, a lost executor costs nothing, and the
    planner knows the size. What was shuffled for it is removed at once, not when the driver collects its garbage."""
    spark, place = df.sparkSession, new_place(df.sparkSession, what)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(place)


def discard(spark: SparkSession, place: str) -> None:
    """Remove a table, or a part of one, that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_BUILT: dict = {}


def version_of(df: DataFrame) -> str:
    """What tells one state of the files behind a table from another: their paths, sizes and times."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    states = []
    for file in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        states.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(states).encode()).hexdigest()


def built_once(what: str, build: Callable[[], Any], *tables: DataFrame) -> Any:
    """What ``build`` gives, built once in a session for the present state of the files behind ``tables``; all that it
    holds must be written to the shared folder."""
    key = (tables[0].sparkSession.sparkContext.applicationId, what, *map(version_of, tables))
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]
