"""Stages as tables in the shared folder, with resume by settings."""

from __future__ import annotations

import atexit
import gc
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Folders of stages that this process wrote; they go when it ends.
MADE: list[str] = []
#: The temporary folder of this process, if it needed one.
OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on a local master, as in tests, a temporary folder of this
    process. On a cluster its executors would each write to a folder of their own, so there it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors share (master {master})")
        if not OWN:
            OWN.append(tempfile.mkdtemp(prefix="reelspark-"))
            MADE.append(OWN[0])
        found = OWN[0]
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. Results read it lazily, so it stays as long as this process does."""
    MADE.append(f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}")
    return MADE[-1]


@atexit.register
def clear() -> None:
    """Removes the stages: local ones directly, those in a store while there is a session to do it."""
    session = SparkSession.getActiveSession()
    for path in MADE:
        local = path.removeprefix("file://")
        if "://" not in local:
            shutil.rmtree(local, ignore_errors=True)
        elif session is not None:
            delete(session, path)
    MADE.clear()
    OWN.clear()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage and reads it back, so that its lineage ends there and lost executors lose nothing."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same with the stage's folder, for a stage that goes before the process ends."""
    spark, schema, path = df.sparkSession, df.schema, stage_path(df.sparkSession, name)
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets Spark find plans that nothing refers to any more, and so remove their shuffle files from the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a stage that later stages have made superfluous."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settings_key(settings: dict) -> str:
    return hashlib.md5(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def resumed(spark: SparkSession, folder: str, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage that a run with equal settings finished is read again; otherwise it is made and stored. A stage counts as
    finished when Spark's commit marker is there and it has rows."""
    path = f"{folder.rstrip('/')}/{name}-{settings_key(settings)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.parquet(path)
        if not done.isEmpty():
            return done
    df = make()
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
