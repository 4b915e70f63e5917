"""Per-document features of normalised losses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe import params
from inkprobe.functions.blocks import flat_of, of_lists, repeated, sliced, with_keys
from inkprobe.session import materialize, small


LONGEST = 200_000  # values of a document in one row
RANGES = 1_024


def role() -> Column:
    return F.when(F.col("chunk_id") == F.col("fold"), "test").otherwise("train")


def _percentile(sorted_values: Column, share: float) -> Column:
    """Linear interpolation between the closest ranks of a sorted array."""
    last = F.size(sorted_values) - 1
    at = last * F.lit(share)
    low = F.floor(at).cast("int")
    a = F.get(sorted_values, low)
    b = F.get(sorted_values, F.least(low + 1, last))
    return a + (b - a) * (at - low)


def _aggregates(value: Column, tag: str) -> list[Column]:
    """What the aggregate features need of one value column."""
    return [F.avg(value).alias(f"mean{tag}"), F.min(value).alias(f"min{tag}"),
            F.max(value).alias(f"max{tag}"), F.stddev_pop(value).alias(f"std{tag}"),
            F.count(value).cast("double").alias(f"count{tag}"),
            F.sort_array(F.collect_list(value)).alias(f"_v{tag}")]


def _named(tag: str) -> list[Column]:
    return [F.col(f"{c}{tag}").alias(c) for c in ("mean", "min", "max", "std", "count")] + [
        _percentile(F.col(f"_v{tag}"), p / 100).alias(f"perc_{p}") for p in params.PERCENTILES]


def agg_features(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, min, max, population deviation, count and exact percentiles.

    A group is one document, so its values fit where its text did.
    """
    return values.groupBy(*by).agg(*_aggregates(F.col(value), "")).select(*by, *_named(""))


def agg_features_folds(rows: DataFrame, by: Sequence[str], n_folds: int, longest: int = LONGEST) -> DataFrame:
    """:func:`agg_features` of the array ``values`` for all folds at once.

    Tokens are shuffled once, whatever the number of folds. Documents of more than
    ``longest`` tokens, which one row should not hold, go through :func:`long_features`.
    """
    by = list(by)
    if "pos" in rows.columns:  # such documents have a token that far
        long = rows.filter(F.col("pos") >= longest).select(*by).distinct()
    else:
        long = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > longest).select(*by)
    long = materialize(long, "long_documents")
    n_long = long.count()
    short = rows if not n_long else rows.join(small(long, n_long), by, "left_anti")
    aggs = [a for f in range(n_folds) for a in _aggregates(F.col("values")[f], f"_{f}")]
    wide = short.groupBy(*by).agg(*aggs)
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), *_named(f"_{f}")) for f in range(n_folds)])
    found = wide.select(*by, F.explode(folds).alias("_f")).select(*by, "_f.*")
    if not n_long:
        return found
    each = rows.join(small(long, n_long), by).select(*by, F.posexplode("values").alias("fold", "value"))
    return found.unionByName(long_features(each, [*by, "fold"], longest).select(*found.columns))


def _described(values: np.ndarray) -> list[float | None]:
    """The aggregate features of one document's values in one fold."""
    v = np.sort(values[~np.isnan(values)])
    if not len(v):
        return [None] * 4 + [0.0] + [None] * len(params.PERCENTILES)
    at = (len(v) - 1) * np.array([p / 100 for p in params.PERCENTILES])
    low = np.floor(at).astype(np.int64)
    a, b = v[low], v[np.minimum(low + 1, len(v) - 1)]
    return [v.mean(), v[0], v[-1], v.std(), float(len(v)), *(a + (b - a) * (at - low)).tolist()]


def _features(batches: Iterable[pa.RecordBatch], by: Sequence[str], n_folds: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sliced(whole, "v_0")):
        columns = [flat_of(batch.column(f"v_{f}")) for f in range(n_folds)]
        offsets = columns[0][0]
        rows = np.flatnonzero(offsets[1:] > offsets[:-1])
        flat = [v.to_numpy(zero_copy_only=False) for _, v in columns]
        found = [_described(v[offsets[r]:offsets[r + 1]]) for r in rows for v in flat]
        which = pa.array(np.repeat(rows, n_folds))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(which) for c in by], pa.array(np.tile(np.arange(n_folds, dtype=np.int32), len(rows))),
             *[pa.array([f[k] for f in found], pa.float64()) for k in range(len(params.AGG_FEATURES))]],
            names=[*by, "fold", *params.AGG_FEATURES])


def agg_features_documents(docs: DataFrame, stored: DataFrame, by: Sequence[str], n_folds: int,
                           longest: int = LONGEST) -> DataFrame:
    """:func:`agg_features_folds` of documents with their values of each fold as arrays ``v_<fold>``.

    A document's features come from its own arrays, without a shuffle. Documents that share ``by``, and those of more than
    ``longest`` tokens, go through :func:`agg_features_folds`; ``stored`` has ``by`` and ``input_ids`` of all documents.
    """
    by = list(by)
    others = materialize(stored.groupBy(*by).agg(F.count("*").alias("_n"), F.max(F.size("input_ids")).alias("_most")).filter(
        (F.col("_n") > 1) | (F.col("_most") > longest)).select(*by), "other_documents")
    schema = T.StructType([*[docs.schema[c] for c in by], T.StructField("fold", T.IntegerType()), *[
        T.StructField(c, T.DoubleType()) for c in params.AGG_FEATURES]])
    columns = [f"v_{f}" for f in range(n_folds)]
    plain = others.isEmpty()
    own = docs if plain else with_keys(docs, others, by, "left_anti")
    found = own.select(*by, *columns).mapInArrow(lambda batches: _features(batches, by, n_folds), schema)
    if plain:
        return found
    each = with_keys(docs, others, by, "left_semi").select(*by, F.explode(F.arrays_zip(*columns)).alias("_v"))
    rows = materialize(each.select(*by, F.array(*[F.col("_v")[c] for c in columns]).alias("values")), "other_values")
    return found.unionByName(agg_features_folds(rows, by, n_folds, longest).select(*found.columns))


def _ranks(n: Column) -> Column:
    """The ranks, from 0, that the percentiles of ``n`` sorted values read."""
    last = n - 1
    low = [F.floor(last * F.lit(p / 100)).cast("bigint") for p in params.PERCENTILES]
    return F.array_distinct(F.array(*low, *[F.least(r + 1, last) for r in low]))


def values_at_ranks(values: DataFrame, by: Sequence[str], wanted: DataFrame, fits: int) -> DataFrame:
    """``(*by, rank, value)``: the value at each wanted rank (from 0) of a group's sorted values.

    Exact without sorting a group: its value range is cut in ``RANGES`` parts, whose
    counts tell which part holds a rank. Parts that hold none drop out; of the
    others, one that is a single value is settled, one of at most ``fits`` values is sorted, and the
    rest is cut again. ``values`` (*by, value) have no NULL.
    """
    by = list(by)
    keys = [*by, "part"]
    rows = materialize(values.select(*by, F.lit("").alias("part"), "value"), "ranked_values")
    open_parts = materialize(rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn(
        "before", F.lit(0).cast("bigint")), "value_ranges")
    settled = []
    while True:
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        asked = materialize(open_parts.join(wanted, by).filter(inside), "asked_ranks")
        flat = F.col("lo") == F.col("hi")
        settled.append(asked.filter(flat).select(*by, "rank", F.col("lo").alias("value")))
        sorted_now = asked.filter(~flat & (F.col("n") <= fits))
        packed = rows.join(sorted_now.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(
            F.sort_array(F.collect_list("value")).alias("_v"))  # at most ``fits`` values a part
        settled.append(sorted_now.join(packed, keys).select(
            *by, "rank", F.get("_v", (F.col("rank") - F.col("before")).cast("int")).alias("value")))
        cut = materialize(asked.filter(~flat & (F.col("n") > fits)).select(
            *keys, "lo", "hi", "before").distinct(), "cut_ranges")
        n_cut = cut.count()
        if not n_cut:
            return reduce(DataFrame.unionByName, settled)
        # Halved, so that no difference overflows; where it vanishes, the largest value parts from the rest.
        half = lambda c: F.col(c) * 0.5
        share = F.coalesce(F.try_divide(half("value") - half("lo"), half("hi") - half("lo")),
                           F.when(F.col("value") >= F.col("hi"), 1.0).otherwise(0.0))
        # Never falls as the value rises; the smallest value lands first and the largest last.
        place = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")
        rows = materialize(rows.select(*keys, "value").join(small(cut, n_cut), keys).select(
            *by, F.concat_ws(".", "part", place.cast("string")).alias("part"), F.col("part").alias("_from"),
            place.alias("_place"), "before", "value"), "ranked_values")
        counted = rows.groupBy(*keys, "_from", "_place").agg(
            F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.first("before").alias("before"))
        earlier = W.partitionBy(*by, "_from").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
        open_parts = materialize(counted.withColumn(
            "before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
            *keys, "n", "lo", "hi", "before"), "value_ranges")


def long_features(values: DataFrame, by: Sequence[str], fits: int = LONGEST, value: str = "value") -> DataFrame:
    """:func:`agg_features` of groups too long for one row; exact, and no row holds more than ``fits`` values."""
    by = list(by)
    x = F.col(value)
    known = materialize(values.select(*by, x.alias("value")).filter("value IS NOT NULL"), "long_values")
    facts = materialize(known.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev_pop("value").alias("std"), F.count("value").alias("_n")), "long_facts")
    wanted = materialize(facts.select(*by, F.explode(_ranks(F.col("_n"))).alias("rank")), "wanted_ranks")
    found = values_at_ranks(known, by, wanted, fits).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))

    def percentile(p: int) -> Column:
        at = (F.col("_n") - 1) * F.lit(p / 100)
        low = F.floor(at).cast("bigint")
        a = F.try_element_at("_at", low)
        b = F.try_element_at("_at", F.least(low + 1, F.col("_n") - 1))
        return (a + (b - a) * (at - low)).alias(f"perc_{p}")

    return facts.join(found, by).select(
        *by, "mean", "min", "max", "std", F.col("_n").cast("double").alias("count"),
        *[percentile(p) for p in params.PERCENTILES])


def hist_edges(train: DataFrame, k: int, by: Sequence[str] = ("fold",), value: str = "value") -> DataFrame:
    """Range ``(lo, hi)`` of k equal bins per fold; only extremes are shuffled."""
    lo, hi = F.min(value), F.max(value)
    flat = lo == hi
    return train.groupBy(*by).agg(
        F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(flat, hi + 0.5).otherwise(hi).alias("hi"), F.lit(k).alias("k"))


def hist_edges_folds(rows: DataFrame, k: int, n_folds: int) -> DataFrame:
    """:func:`hist_edges` of the array ``values`` in one pass, training chunks only."""
    seen = lambda f: F.when(F.col("chunk_id") != f, F.col("values")[f])
    ends = rows.agg(*[a for f in range(n_folds)
                      for a in (F.min(seen(f)).alias(f"lo_{f}"), F.max(seen(f)).alias(f"hi_{f}"))])
    each = ends.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("fold"), F.col(f"lo_{f}").alias("value"), F.col(f"hi_{f}").alias("top"))
        for f in range(n_folds)])).alias("_f")).select("_f.*")
    pairs = each.select("fold", "value").unionByName(each.select("fold", F.col("top").alias("value")))
    return hist_edges(pairs, k)


def edge(i: Column, k: int) -> Column:
    """Edge i of k bins; the last is ``hi`` itself."""
    step = (F.col("hi") - F.col("lo")) / k
    return F.when(i == k, F.col("hi")).otherwise(F.col("lo") + i * step)


def hist_features(values: DataFrame, edges: DataFrame, k: int, by: Sequence[str],
                  n_folds: int | None = params.N_CHUNKS, value: str = "value",
                  edge_by: Sequence[str] = ("fold",)) -> DataFrame:
    """Densities ``(*by, bin, density)`` of the non-empty bins.

    Values out of range count nowhere. A document without any value in range
    has one row with NULL bin and NaN density.
    """
    x = F.col(value)
    rows = values.join(small(edges.select(*edge_by, "lo", "hi"), n_folds), list(edge_by))
    inside = (x >= F.col("lo")) & (x <= F.col("hi"))
    step = (F.col("hi") - F.col("lo")) / k
    guess = F.least(F.greatest(F.floor((x - F.col("lo")) / step).cast("int"), F.lit(0)), F.lit(k - 1))
    rows = rows.withColumn("_g", F.when(inside, guess))
    g = F.col("_g")
    settled = F.when(x < edge(g, k), g - 1).when((g < k - 1) & (x >= edge(g + 1, k)), g + 1).otherwise(g)
    counted = rows.withColumn("bin", settled).groupBy(*by, "bin").agg(
        F.count("*").alias("_c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    b = F.col("bin")
    found = F.sum(F.when(b.isNotNull(), F.col("_c")).otherwise(0)).over(W.partitionBy(*by))
    width = edge(b + 1, k) - edge(b, k)
    dense = counted.withColumn("_in", found).filter(b.isNotNull() | (F.col("_in") == 0))
    return dense.select(*by, "bin", F.when(b.isNull(), F.lit(float("nan"))).otherwise(
        F.try_divide(F.col("_c").cast("double"), F.col("_in") * width)).alias("density"))


def dense_vectors(hist: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """One array of k densities per document, for the edge to Spark ML.

    A document without any value in range gets NULL entries.
    """

    @F.pandas_udf("array<double>")
    def scatter(bins: pd.Series, values: pd.Series) -> pd.Series:
        lengths = np.fromiter(map(len, bins), np.int64, len(bins))
        out = np.zeros((len(bins), k))
        if lengths.any():
            row = np.repeat(np.arange(len(bins)), lengths)
            out[row, np.concatenate(bins.to_numpy()).astype(np.int64)] = np.concatenate(values.to_numpy())
        out[lengths == 0] = np.nan
        return pd.Series(list(out))

    packed = F.sort_array(F.collect_list(
        F.when(F.col("bin").isNotNull(), F.struct("bin", "density"))))
    rows = hist.groupBy(*by).agg(packed.alias("_h"))
    return rows.select(*by, scatter(F.col("_h.bin"), F.col("_h.density")).alias("x"))


def hist_edges_documents(docs: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """:func:`hist_edges_folds` of documents with the values of each fold in the arrays ``columns``."""
    ends = lambda f, c: F.array(F.array_min(c), F.array_max(c))
    return hist_edges_folds(docs.select("chunk_id", F.explode(F.arrays_zip(*[
        ends(f, c).alias(f"_{f}") for f, c in enumerate(columns)])).alias("_e")).select(
        "chunk_id", F.array(*[F.col("_e")[f"_{f}"] for f in range(len(columns))]).alias("values")), k, len(columns))


def _histograms(batches: Iterable[pa.RecordBatch], by: Sequence[str], columns: Sequence[str],
                limits: Sequence[tuple[float, float]], k: int) -> Iterator[pa.RecordBatch]:
    """Of each document with values and fold, the filled bins and their densities, as :func:`hist_features` gives them."""
    for batch in (part for whole in batches for part in sliced(whole, columns[0])):
        offsets = flat_of(batch.column(columns[0]))[0]
        sizes = np.diff(offsets)
        there = np.flatnonzero(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        for fold, (name, (lo, hi)) in enumerate(zip(columns, limits)):
            x = flat_of(batch.column(name))[1].to_numpy(zero_copy_only=False)
            inside = (x >= lo) & (x <= hi)  # never of NaN
            x, own, step = x[inside], doc[inside], (hi - lo) / k
            at = lambda i: np.where(i == k, hi, lo + i * step)
            g = np.clip(np.floor((x - lo) / step), 0, k - 1).astype(np.int64)
            g = np.where(x < at(g), g - 1, np.where((g < k - 1) & (x >= at(g + 1)), g + 1, g))
            keys, counts = np.unique(own * k + g, return_counts=True)
            row, bin_ = keys // k, keys % k
            found = np.bincount(row, counts, len(sizes))
            share = found[row] * (at(bin_ + 1) - at(bin_))
            with np.errstate(divide="ignore", invalid="ignore"):
                density = pa.array(counts / share, mask=share == 0)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes))[there])])
            which = pa.array(there)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), fold, np.int32)), *[batch.column(c).take(which) for c in by],
                 of_lists(ends, pa.array(bin_.astype(np.int32))), of_lists(ends, density)],
                names=["fold", *by, "bin", "density"])


def hist_features_documents(docs: DataFrame, stored: DataFrame, edges: DataFrame, k: int, by: Sequence[str],
                            columns: Sequence[str]) -> DataFrame:
    """:func:`hist_features` of documents with the values of each fold in the arrays ``columns``.

    A row a document and fold, ``(fold, *by, bin, density)`` with arrays of the filled bins, which come from the document's own
    arrays without a shuffle. Only documents that share ``by`` are counted by rows; ``stored`` has ``by`` of all documents.
    """
    by, columns = list(by), list(columns)
    held = {r["fold"]: (r["lo"], r["hi"]) for r in edges.collect()}  # one a fold
    limits = [tuple(float("nan") if v is None else v for v in held.get(f, (None, None))) for f in range(len(columns))]
    schema = T.StructType([T.StructField("fold", T.IntegerType()), *[docs.schema[c] for c in by],
                           T.StructField("bin", T.ArrayType(T.IntegerType())), T.StructField("density", T.ArrayType(T.DoubleType()))])
    shared = repeated(stored.select(*by), by)
    own = docs if shared is None else with_keys(docs, shared, by, "left_anti")
    names = list(dict.fromkeys(columns))
    found = own.select(*by, *names).mapInArrow(lambda batches: _histograms(batches, by, columns, limits, k), schema)
    if shared is None:
        return found
    each = with_keys(docs, shared, by, "left_semi").select(*by, F.explode(F.arrays_zip(*names)).alias("_v")).select(
        *by, F.posexplode(F.array(*[F.col("_v")[c] for c in columns])).alias("fold", "value"))
    packed = F.sort_array(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "density"))))
    rows = hist_features(each, edges, k, ["fold", *by], len(columns)).groupBy("fold", *by).agg(packed.alias("_h"))
    return found.unionByName(rows.select("fold", *by, F.col("_h.bin").alias("bin"), F.col("_h.density").alias("density")))


def unpacked(hist: DataFrame) -> DataFrame:
    """Rows as :func:`hist_features` gives them, of :func:`hist_features_documents`."""
    by = [c for c in hist.columns if c not in ("bin", "density")]
    each = hist.select(*by, F.explode_outer(F.arrays_zip("bin", "density")).alias("_h"))
    none = F.col("_h.bin").isNull()
    return each.select(*by, F.col("_h.bin").alias("bin"), F.when(none, F.lit(float("nan"))).otherwise(
        F.col("_h.density")).alias("density"))


def scale_columns(features: DataFrame, cols: Sequence[str], n_folds: int | None = params.N_CHUNKS,
                  by: Sequence[str] = ("fold",)) -> DataFrame:
    """Min-max scale with the training rows of each fold; constant columns become 0.

    ``features`` has ``role``; test rows may leave [0, 1].
    """
    train = F.col("role") == "train"
    seen = lambda c: F.when(train, F.col(c))
    limits = features.groupBy(*by).agg(
        *[F.min(seen(c)).alias(f"_lo_{c}") for c in cols],
        *[F.max(seen(c)).alias(f"_hi_{c}") for c in cols])
    rest = [c for c in features.columns if c not in cols]
    scaled = lambda c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), F.lit(0.0)).otherwise(
        F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")))
    return features.join(small(limits, n_folds), list(by)).select(
        *rest, *[scaled(c).alias(c) for c in cols])


def scale_vectors(vectors: DataFrame, hist: DataFrame, k: int, n_folds: int | None = params.N_CHUNKS) -> DataFrame:
    """:func:`scale_columns` for histogram arrays, limits taken from the sparse rows.

    ``hist`` and ``vectors`` carry fold and role. A bin some training document
    lacks has minimum 0.
    """
    train = hist.filter("role = 'train'")
    docs = vectors.filter("role = 'train'").groupBy("fold").agg(F.count("*").alias("_docs"))
    per = train.filter("bin IS NOT NULL").groupBy("fold", "bin").agg(
        F.min("density").alias("_lo"), F.max("density").alias("_hi"), F.count("*").alias("_n"))
    per = per.join(small(docs, n_folds), "fold").withColumn(
        "_lo", F.when(F.col("_n") < F.col("_docs"), F.least(F.lit(0.0), "_lo")).otherwise(F.col("_lo")))
    zeros = per.select("fold").distinct().select(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("bin"),
        F.lit(0.0).alias("_lo"), F.lit(0.0).alias("_hi"))
    filled = per.select("fold", "bin", "_lo", "_hi", F.lit(1).alias("_real")).unionByName(
        zeros.withColumn("_real", F.lit(0))).groupBy("fold", "bin").agg(
        F.max_by(F.struct("_lo", "_hi"), "_real").alias("_r"))
    limits = filled.groupBy("fold").agg(
        F.sort_array(F.collect_list(F.struct("bin", "_r._lo", "_r._hi"))).alias("_limits"))
    scaled = F.zip_with("x", "_limits", lambda v, r: F.when(r["_lo"] == r["_hi"], F.lit(0.0)).otherwise(
        F.try_divide(v - r["_lo"], r["_hi"] - r["_lo"])))
    return vectors.join(small(limits, n_folds), "fold").withColumn("x", scaled).drop("_limits")


def feature_kind(name: str) -> int | None:
    """Bins of 'hist_<k>', None for 'simple_agg'; anything else is an error."""
    if name == "simple_agg":
        return None
    head, _, tail = name.partition("_")
    if head == "hist" and tail.isdigit():
        return int(tail)
    raise ValueError(f"no such feature extraction: {name!r}")


def scaled_aggregates(features: DataFrame, n_folds: int = params.N_CHUNKS) -> DataFrame:
    """Scaled feature arrays of the aggregate features of documents and folds."""
    scaled = scale_columns(materialize(features, "features").withColumn("role", role()), params.AGG_FEATURES, n_folds)
    return scaled.select("fold", "doc_id", "chunk_id", "label", "role", F.array(*params.AGG_FEATURES).alias("x"))


def extract_scaled(rows: DataFrame, kind: str, n_folds: int = params.N_CHUNKS) -> DataFrame:
    """Scaled feature arrays ``(fold, doc_id, chunk_id, label, role, x)``.

    ``rows`` has the per-fold array ``values``. Tokens meet their document once;
    counting, totals and packing then stay within that partitioning.
    """
    doc = ["doc_id", "chunk_id", "label"]
    by = ["fold", *doc]
    k = feature_kind(kind)
    local = rows.select(*doc, "values").repartition("doc_id")
    if k is None:
        return scaled_aggregates(agg_features_folds(
            rows.select(*doc, *(["pos"] if "pos" in rows.columns else []), "values"), doc, n_folds), n_folds)
    edges = materialize(hist_edges_folds(rows, k, n_folds), "edges")
    values = local.select(*doc, F.posexplode("values").alias("fold", "value"))
    hist = materialize(hist_features(values, edges, k, by, n_folds), "hist").withColumn("role", role())
    vectors = dense_vectors(hist, k, [*by, "role"])
    return scale_vectors(vectors, hist, k, n_folds)


DENSE_ROWS = 512  # made at a time, of as many numbers as there are bins


def _dense(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """:func:`dense_vectors` of rows that hold their bins and densities as arrays, a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, DENSE_ROWS):
            part = batch.slice(start, DENSE_ROWS)
            offsets, bins = flat_of(part.column("bin"))
            sizes = np.diff(offsets)
            out = np.zeros((part.num_rows, k))
            out[np.repeat(np.arange(len(sizes)), sizes), bins.to_numpy(zero_copy_only=False)] = flat_of(
                part.column("density"))[1].to_numpy(zero_copy_only=False)
            out[sizes == 0] = np.nan
            x = of_lists(np.arange(part.num_rows + 1) * k, pa.array(out.ravel(), from_pandas=True))
            rest = part.drop_columns(["bin", "density"])
            yield pa.RecordBatch.from_arrays([*rest.columns, x], names=[*rest.schema.names, "x"])


def scaled_histograms(docs: DataFrame, stored: DataFrame, k: int, columns: Sequence[str]) -> DataFrame:
    """:func:`extract_scaled` of histograms of documents with the values of each fold in the arrays ``columns``."""
    doc = ["doc_id", "chunk_id", "label"]
    edges = materialize(hist_edges_documents(docs, k, columns), "edges")
    hist = materialize(hist_features_documents(docs, stored, edges, k, doc, columns), "hist").withColumn("role", role())
    schema = T.StructType([*[f for f in hist.schema if f.name not in ("bin", "density")], T.StructField("x", T.ArrayType(T.DoubleType()))])
    vectors = hist.mapInArrow(lambda batches: _dense(batches, k), schema).select("fold", *doc, "role", "x")
    return scale_vectors(vectors, unpacked(hist), k, len(columns))
