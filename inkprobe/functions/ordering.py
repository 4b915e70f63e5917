"""Global order without a single-task sort.

Ranks and running totals are taken inside buckets that follow the order; only
per-bucket totals, whose number is fixed, are accumulated in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.session import materialize, small

N_SPLITS = 256
MAX_SPLITS = 4_096


def n_splits(spark: SparkSession) -> int:
    """Number of ordered buckets: it follows the session's shuffle partitions.

    Neither number need be set: the first has no default, the second has Spark's own.
    """
    named = [spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None),
             spark.conf.get("spark.sql.shuffle.partitions")]
    return min(MAX_SPLITS, max([N_SPLITS, *[int(n) for n in named if n]]))


def hash_key(seed: int, key: str) -> Column:
    """Seeded pseudo-random order that any engine with md5 can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


HASH_BUCKETS = 16 ** params.HASH_DIGITS


def hash_bucket(key: str, seed: int) -> Column:
    """Number of the hash prefix; follows the order of :func:`hash_key`."""
    return F.conv(F.substring(hash_key(seed, key), 1, params.HASH_DIGITS), 16, 10).cast("int")


def hash_rank(df: DataFrame, key: str, seed: int, group: str | None = None,
              max_groups: int | None = 1, upto: Column | int | None = None) -> DataFrame:
    """Add ``rank`` (from 1) in seeded hash order and ``group_size``.

    md5 spreads keys evenly, so a fixed prefix splits any input, however large
    one group is, into buckets of equal expected size. With ``upto``, buckets that
    start beyond that rank are left out before anything is ranked. ``df`` should
    hold little but keys; join the rest to the ranks.
    """
    keyed = df.withColumn("_h", hash_key(seed, key)).withColumn("_b", hash_bucket(key, seed))
    by = [group] if group else []
    sizes = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias("group_size"))
    if upto is not None:
        offsets = offsets.filter(F.col("_before") < upto)
    bound = HASH_BUCKETS * max_groups if max_groups else None
    inside = W.partitionBy(*by, "_b").orderBy("_h", key)
    return (
        keyed.join(small(offsets, bound), [*by, "_b"])
        .withColumn("rank", F.row_number().over(inside) + F.col("_before"))
        .drop("_h", "_b", "_before"))


def ordered_buckets(df: DataFrame, order: str, group: Sequence[str] = ()) -> DataFrame:
    """Add ``_b``, a bucket number that rises with ``order``.

    Split points are approximate quantiles; that only affects how even the
    buckets are, never the order, so results built on them stay exact.
    """
    n = n_splits(df.sparkSession)
    shares = [i / n for i in range(1, n)]
    points = F.percentile_approx(order, shares, 10 * MAX_SPLITS).alias("_splits")
    if group:
        df = df.join(df.groupBy(*group).agg(points), list(group))
        splits = F.col("_splits")
    else:
        splits = df.agg(points).scalar()
        df = df.withColumn("_splits", splits)
        splits = F.col("_splits")
    bucket = F.size(F.filter(splits, lambda s: s < F.col(order)))
    return df.withColumn("_b", bucket).drop("_splits")


def running_totals(df: DataFrame, order: str, sums: Sequence[str],
                   group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """For each row, ``cum_<s>``: total of ``s`` up to and including it, and ``total_<s>``.

    Rows must be unique per group and ``order`` (aggregate ties first). Adds
    ``next_<s>`` (value of the following row) as well.
    """
    group = list(group)
    df = materialize(df, "ordered")  # read three times below
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    rows = ordered_buckets(df, order, group)
    first = F.min_by if not descending else F.max_by
    per = rows.groupBy(*group, "_b").agg(
        *[F.sum(s).alias(f"_s_{s}") for s in sums],
        *[first(s, order).alias(f"_f_{s}") for s in sums])
    line = W.partitionBy(*group).orderBy(way("_b"))
    before = line.rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        *group, "_b",
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(W.partitionBy(*group)).alias(f"total_{s}") for s in sums],
        *[F.lead(f"_f_{s}").over(line).alias(f"_after_{s}") for s in sums])
    inside = W.partitionBy(*group, "_b").orderBy(way(order))
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = rows.join(per, [*group, "_b"])
    return joined.select(
        *df.columns,
        *[(F.sum(s).over(upto) + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.coalesce(F.lead(s).over(inside), F.col(f"_after_{s}")).alias(f"next_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums])
