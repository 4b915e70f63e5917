"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprobe import params


PARTITION_BYTES = 128 << 20


def build_session(app: str = "inkprobe", master: str | None = None, input_bytes: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and last-wins maps.

    Adaptive execution merges small shuffle partitions but doesn't split those of
    an aggregation, so a large input should be named: shuffles then start from
    one partition for each ``PARTITION_BYTES`` of ``input_bytes``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    if input_bytes:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(
            max(200, -(-input_bytes // PARTITION_BYTES)))
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach, as the session names it.

    Raises where neither ``spark.checkpoint.dir`` nor ``setCheckpointDir`` named
    one: a folder of this machine would not be seen by other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def name_local_folder(spark: SparkSession, folder: str) -> None:
    """Let a session on one machine keep its stage tables in ``folder``; does nothing if one is named."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder)


def run_root(spark: SparkSession) -> str:
    """The one folder below which a run keeps all its stage tables."""
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{run_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_run(spark: SparkSession) -> None:
    """Remove the run's stage tables; for the run's owner, once no result reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Losing executors afterwards costs a re-read and not a recomputation. Readers
    of one value of ``partition_by`` skip the rest.
    """
    path = run_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def small(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast ``df`` when its row bound is known and low; else let Spark choose."""
    if max_rows is not None and max_rows <= params.MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df
