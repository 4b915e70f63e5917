"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16


def per_class(rows: DataFrame, key: str, label: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` keys of each label in seeded hash order, each once.

    Labels of many keys are cut first, to the keys whose hash lies below a bound
    that about twice ``most`` of them pass; so what is ranked doesn't grow with the table.
    The few labels above the bound are those that the model holds anyway. A label is
    ranked in ``SALTS`` parts of its own before they meet. ``rows`` should be narrow.
    """
    place = F.xxhash64(F.lit(seed), key)
    rows = rows.select(key, label)
    keys = rows.groupBy(label).agg(F.approx_count_distinct(place, 0.05).alias("keys"))
    passes = F.lit(True)
    for r in keys.filter(F.col("keys") > 4 * most).collect():
        share = 2 * most / r["keys"]
        bound = int(-(1 << 63) + share * (1 << 64))
        passes = passes & ~((F.col(label) == F.lit(r[label])) & (place > F.lit(bound)))
    rows = rows.filter(F.coalesce(passes, F.lit(True))).distinct()
    for by in ([label, F.pmod(place, F.lit(SALTS))], [label]):
        order = W.partitionBy(*by).orderBy(place, key)
        rows = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")
    return rows
