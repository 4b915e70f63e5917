"""Sampling, chunking, splitting and row selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.functions.ordering import HASH_BUCKETS, hash_bucket, hash_key, hash_rank
from inkprobe.session import materialize, small


def sample_n(df: DataFrame, n: int, seed: int = params.SEED, key: str = "doc_id",
             strict: bool = True) -> DataFrame:
    """n rows without replacement, in the column ``rank``; too few rows are an error.

    Only keys are ranked; the drawn ones then fetch their rows. Keys are unique.
    """
    if strict:
        there = df.count()
        if there < n:
            raise ValueError(f"sample larger than population: {n} of {there} rows")
    drawn = hash_rank(df.select(key), key, seed, upto=n).filter(F.col("rank") <= n).select(key, "rank")
    if df.columns == [key]:
        return drawn
    return df.join(small(drawn, n), key).select(*df.columns, "rank")


def cap_rows(df: DataFrame, cap: int | None, seed: int, key: str = "doc_id") -> DataFrame:
    """Sample inputs longer than ``cap`` down to it; None keeps everything."""
    if cap is None:
        return df
    return sample_n(df, cap, seed, key, strict=False).drop("rank")


def filter_year(df: DataFrame, col: str, lo: int = params.YEAR_LO, hi: int = params.YEAR_HI,
                cap: int | None = None, seed: int = params.SEED,
                strict: bool = False) -> DataFrame:
    """Rows whose year lies in [lo, hi]; NULL years go. ``strict`` fails on other text."""
    year = F.col(col).cast("int") if strict else F.expr(f"try_cast(`{col}` AS INT)")
    return cap_rows(df, cap, seed).filter(year.between(lo, hi))


def min_tokens(df: DataFrame, n: int = params.MIN_TOKENS, cap: int | None = None,
               seed: int = params.SEED) -> DataFrame:
    """Documents longer than ``n`` tokens; ``n`` <= 0 keeps all of them.

    Works on ``n_tokens`` where present, else on ``input_ids``.
    """
    if n <= 0:
        return df
    length = F.col("n_tokens") if "n_tokens" in df.columns else F.size("input_ids")
    return cap_rows(df, cap, seed).filter(length > n)


def select_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows named by ``ids(ordinal, <key>)``, in the order of ``ordinal``."""
    return df.join(ids, key).orderBy("ordinal")


def first_n(df: DataFrame, n: int | None, order: str = "doc_id") -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


def id_range(df: DataFrame, start: int, finish: int, key: str = "doc_id") -> DataFrame:
    return df.filter((F.col(key) >= start) & (F.col(key) < finish))


def id_list(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def label_classes(members: DataFrame, non_members: DataFrame) -> DataFrame:
    """Members then non-members, labelled 1 and 0."""
    return members.withColumn("label", F.lit(1)).unionByName(
        non_members.withColumn("label", F.lit(0)))


def split_chunks(members: DataFrame, non_members: DataFrame, n_chunks: int = params.N_CHUNKS,
                 n_pos: int | None = None, min_len: int = params.MIN_TOKENS,
                 seed: int = params.SEED, cap: int | None = None) -> DataFrame:
    """Balanced chunks ``(doc_id, chunk_id, row_in_chunk, label)``.

    ``n_pos`` members and as many non-members per chunk; when None, as many as
    the smaller class allows. Only ids move; texts join afterwards.
    """
    long = [min_tokens(d, min_len, cap, seed).select("doc_id") for d in (members, non_members)]
    classed = materialize(label_classes(*long), "classes")  # counted and ranked below
    found = {r["label"]: r["n"] for r in classed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    smaller = min(found.get(1, 0), found.get(0, 0))
    per = smaller // n_chunks if n_pos is None else n_pos
    if not per or smaller < n_chunks * per:
        raise ValueError(f"a class is smaller than {n_chunks} chunks of {per or 'one or more'} rows need; the "
                         f"classes have {found.get(1, 0)} members and {found.get(0, 0)} non-members")
    ranked = hash_rank(classed, "doc_id", seed, group="label", max_groups=2, upto=n_chunks * per)
    before = F.col("rank") - 1
    return ranked.filter(F.col("rank") <= n_chunks * per).select(
        "doc_id",
        F.floor(before / per).cast("int").alias("chunk_id"),
        (before % per + F.when(F.col("label") == 0, per).otherwise(0)).cast("int").alias("row_in_chunk"),
        "label")


def dated_chunks(members: DataFrame, non_members: DataFrame, member_date: str = "publication_date",
                 non_member_date: str = "original_publication", lo: int = params.YEAR_LO, hi: int = params.YEAR_HI,
                 cap: int | None = None, seed: int = params.SEED, **chunking) -> DataFrame:
    """:func:`split_chunks` of the documents of either class whose own date column has a year in [lo, hi]."""
    return split_chunks(filter_year(members, member_date, lo, hi, cap, seed),
                        filter_year(non_members, non_member_date, lo, hi, cap, seed), seed=seed, **chunking)


def random_split(df: DataFrame, test: float = params.TEST_SHARE, seed: int = params.SEED,
                 key: str = "doc_id") -> DataFrame:
    """Add ``role``; the first ceil(test * n) rows in seeded hash order are 'test'.

    Only the bucket that holds the cut is ranked; the others lie on one side of it.
    """
    cut = math.ceil(df.count() * test)
    bucket = hash_bucket(key, seed)
    sizes = df.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n"))
    line = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sides = sizes.select("_b", "_n", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    sides = sides.select("_b", F.when(F.col("_before") + F.col("_n") <= cut, "test").when(
        F.col("_before") >= cut, "train").alias("_side"), (cut - F.col("_before")).alias("_left"))
    placed = df.withColumn("_b", bucket).join(small(sides, HASH_BUCKETS), "_b")
    settled = placed.filter(F.col("_side").isNotNull()).withColumn("role", F.col("_side"))
    order = W.partitionBy("_b").orderBy(hash_key(seed, key), key)
    mixed = placed.filter(F.col("_side").isNull()).withColumn(
        "role", F.when(F.row_number().over(order) <= F.col("_left"), "test").otherwise("train"))
    return settled.unionByName(mixed).select(*df.columns, "role")


def with_labels(scores: DataFrame, labels: DataFrame, cols: Sequence[str] = ("label",)) -> DataFrame:
    """Attach labels by document id."""
    return scores.join(labels.select("doc_id", *cols), "doc_id")
