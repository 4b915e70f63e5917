"""Reading corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.operators import books

JSONL_FIELDS = ("meta", "text")
FEW_TASKS = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to process; one of a few scan tasks is spread over the cores.

    A row group is read by one task, however many cores wait. Only scans of fewer
    than ``FEW_TASKS`` tasks are dealt anew, so what is shuffled never exceeds so
    many file splits, whatever the cluster.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < min(cores, FEW_TASKS):
        return df.repartition(cores, key)
    return df


def parse_jsonl(lines: DataFrame, col: str = "value", on_missing: str = "error") -> DataFrame:
    """``meta`` (as JSON text) and ``text`` of JSON lines; malformed lines are skipped.

    ``on_missing`` decides about well-formed lines that lack a field: 'error',
    'null' or 'skip'.
    """
    if on_missing not in ("error", "null", "skip"):
        raise ValueError(f"on_missing must be error, null or skip, not {on_missing!r}")
    rest = [c for c in lines.columns if c != col]
    rows = lines.select(*rest, F.try_parse_json(F.col(col)).alias("_v")).filter("_v IS NOT NULL")
    # A field that is absent gives NULL, one that holds null gives a variant null.
    rows = rows.select(*rest, *[F.try_variant_get("_v", f"$.{f}", "variant").alias(f"_{f}") for f in JSONL_FIELDS])
    there = reduce(Column.__and__, [F.col(f"_{f}").isNotNull() for f in JSONL_FIELDS])
    if on_missing == "error":
        rows = rows.filter(F.when(there, F.lit(True)).otherwise(
            F.raise_error(F.lit("a line lacks meta or text")).cast("boolean")))
    elif on_missing == "skip":
        rows = rows.filter(there)
    return rows.select(
        *rest, F.to_json("_meta").alias("meta"), F.try_variant_get("_text", "$", "string").alias("text"))


def malformed_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """The lines :func:`parse_jsonl` skips, for the log."""
    return lines.filter(F.try_parse_json(F.col(col)).isNull())


def read_jsonl_corpus(spark: SparkSession, path: str, on_missing: str = "error") -> DataFrame:
    lines = spark.read.text(path, pathGlobFilter="*.jsonl").filter(F.trim("value") != "")
    return parse_jsonl(lines, on_missing=on_missing)


def union_splits(*splits: DataFrame) -> DataFrame:
    """All splits of a dataset as one table; columns meet by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), splits)


def read_splits(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return union_splits(*[spark.read.parquet(p) for p in paths])


def read_book_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole book files ``(path, content)``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def recent_books(files: DataFrame, date: str = params.RELEASE_CUTOFF) -> DataFrame:
    """Files released after ``date``; unparsable files are left out."""
    dated = files.withColumn("release_date", books.release_date(books.header_of(F.col("content"))))
    return books.released_after(dated, date)


def read_book_corpus(spark: SparkSession, path: str, date: str = params.RELEASE_CUTOFF) -> DataFrame:
    """Book corpus of all recent files of a folder."""
    recent = recent_books(read_book_files(spark, path), date)
    text = recent.select("path", F.col("content").cast("string").alias("text"))
    return books.book_corpus(books.parse_books(text))
