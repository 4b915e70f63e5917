"""Left lookup joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe import params


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
                spread: Sequence[str], probes: DataFrame | None = None, weight: str = "n",
                slots: int = params.HOT_SLOTS) -> DataFrame:
    """Left join on ``keys``, the first a non-negative integer or a text without NUL; hot keys by broadcast.

    ``right`` is unique on the keys. ``probes`` says how many rows of ``left`` hold
    each key, in ``weight``; without it they are counted. A key is hot when it holds
    at least 1/slots of them: by counting, at most ``slots`` keys can be, whether
    ``right`` knows them or not, which bounds the broadcast at any data size. Rows
    settled by it, and rows without a key, are scattered over the shuffle of the others.
    """
    keys, values = list(keys), list(values)
    if probes is None:
        probes = left.groupBy(*keys).agg(F.count("*").alias(weight))
    total = probes.agg(F.sum(weight)).scalar()
    hot_keys = probes.filter(F.col(weight) * F.lit(slots) >= total).select(*keys)
    found = right.select(*keys, F.struct(*values).alias("_found"))
    kind = "string" if left.schema[keys[0]].dataType.typeName() == "string" else "bigint"
    cold = found.select(F.col(keys[0]).cast(kind).alias("_k0"), *keys[1:], F.col("_found").alias("_cold"))
    place = F.pmod(F.xxhash64(*spread), F.lit(1 << 20))
    scattered = F.concat(F.lit("\0"), place.cast("string")) if kind == "string" else -1 - place
    # Hot keys that ``right`` lacks are settled as well, with nothing found.
    stays = F.col("_is_hot").isNull() & F.col(keys[0]).isNotNull()
    marked = left.join(F.broadcast(hot_keys.withColumn("_is_hot", F.lit(True))), keys, "left").withColumn(
        "_k0", F.when(stays, F.col(keys[0]).cast(kind)).otherwise(scattered.cast(kind))).drop("_is_hot")
    joined = marked.join(cold, ["_k0", *keys[1:]], "left")
    # What hot keys find is added after the shuffle, so that it does not travel with their rows.
    known = found.join(F.broadcast(hot_keys), keys).withColumnRenamed("_found", "_hot")
    return joined.join(F.broadcast(known), keys, "left").select(
        *left.columns, *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], spread: Sequence[str],
           max_rows: int | None, probes: DataFrame | None = None, weight: str = "n", row_bytes: int = 64) -> DataFrame:
    """:func:`lookup_join`, or a plain broadcast where the bound on ``right``'s rows and bytes is known and low."""
    if max_rows is not None and max_rows <= params.MAX_BROADCAST_ROWS and (
            max_rows * row_bytes <= params.MAX_BROADCAST_BYTES):
        return left.join(F.broadcast(right.select(*keys, *values)), list(keys), "left").select(*left.columns, *values)
    return lookup_join(left, right, keys, values, spread, probes, weight)
