"""Token counts kept up to date while documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkprobe.operators import tokens as tk


def read_documents(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    """Rows of the tables in ``folder`` whose name matches ``glob``, each a file or a folder of files."""
    # A stream takes one file only by a pattern, which a name becomes by a class of one letter.
    name = glob if any(c in glob for c in "*?[{") else f"{glob[:-1]}[{glob[-1]}]"
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}")


def running_counts(docs: DataFrame) -> DataFrame:
    """Word counts over all documents seen so far; the state holds one row per word."""
    return tk.word_table(docs).groupBy(F.col("word").alias("token")).agg(F.count("*").alias("n"))


def count_into(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, writing each batch's counts as a replaceable partition.

    A batch that is retried after a failure overwrites its own partition, so
    every document counts once. Summing the partitions gives the counts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (running_counts(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, n bigint, batch_id int").parquet(path).groupBy("token").agg(F.sum("n").alias("n"))
