"""Session settings and the two physical helpers every module shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fan-out used where a join key may be hot.  Rows of the large side are spread over
#: this many sub-keys; the other side is repeated once per sub-key.
SALTS = 16


def build_session(cpus: int | str = 8, app: str = "quire") -> SparkSession:
    """Local session for tests and the bench.  A cluster passes its own settings."""
    cpus = int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else one beside the warehouse.

    Only a session in one process, as in tests, gets a temporary folder, which goes with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="quire-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quire-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, piece: int = 1 << 18) -> DataFrame:
    """Split a small input over the cores before per-row CPU work.

    A small table may sit in one file block, hence in one task.  The plan's size estimate
    decides: only inputs below one scan partition per core are moved, larger ones already
    arrive in many partitions and are left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * (128 << 20):
        return df
    return df.repartition(max(1, min(cores, size // piece + 1)), key)


def salt_of(*cols: str | Column, n: int = SALTS) -> Column:
    """Sub-key of a row of the large side."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def repeat_per_salt(df: DataFrame, n: int = SALTS, name: str = "salt") -> DataFrame:
    """Other side of a salted join: each row once per sub-key."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` lets Spark keep only k rows per group and task before the
    shuffle, so a group holding most of the table never lands in one task whole.
    """
    from pyspark.sql import Window

    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if k is not None:
        out = out.filter(F.col(name) <= k)
    return out if rank else out.drop(name)
