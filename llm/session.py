"""What every operator of this folder needs from the Spark session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 4_000_000
ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> None:
    """Let Python workers find this package, and name a checkpoint folder where the cluster names none."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH", "") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    # Rows of very different length: what a Python worker gets at once is bounded in bytes, too.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own.get("path") or _own.setdefault("path", "file://" + tempfile.mkdtemp(prefix="llm-work-"))
    return path


_own: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def clean(spark: SparkSession | None = None) -> None:
    """Delete the tables that operators have written on their way. Results not read yet may still need them."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def _at_exit() -> None:
    try:
        clean()
    except Exception:  # noqa: BLE001 - the session is gone already
        pass


atexit.register(_at_exit)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there and any executor may be lost."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(column: str) -> str:
    """SQL for the unsigned CRC-32 of an id written as text; null ids give null."""
    return f"crc32(cast({column} as string))"
