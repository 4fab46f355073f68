"""Session helpers: settings the plans rely on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "txnlens", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; size-dependent settings stay with the caller."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


# Places given out in this process, oldest first.
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share.

    The setting is the cluster's word and taken as it is. Where it is unset, a session on one
    machine stores beside its warehouse; any other is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/txnlens-stored"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``release``."""
    path = f"{shared_dir(spark)}/txnlens/{label}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the stored table.

    Cuts the lineage like ``checkpoint()``, and later passes read only the columns they need. The
    tables stay until ``release`` or the cluster's own clean-up.
    """
    spark = df.sparkSession
    path = new_place(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete everything stored in this process; frames built on it end with it.

    Returns how many tables and folders were deleted.
    """
    conf, deleted = spark._jsc.hadoopConfiguration(), 0
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        deleted += bool(path.getFileSystem(conf).delete(path, True))
    return deleted


def spread(df: DataFrame) -> DataFrame:
    """Give a small input that was read in few pieces to all cores, ahead of costly work per row.

    Decided by the number of pieces in the plan; an input with enough of them is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
