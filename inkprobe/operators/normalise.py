"""Norm tables and per-token normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe import params
from inkprobe.functions.blocks import Find, flat_of, look_up, of_lists, ranges, sliced
from inkprobe.functions.skew import lookup
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk
from inkprobe.session import materialize, small

KINDS = ("none", "ratio", "diff_max_token_proba")


def fold_norms(norm: DataFrame, chunk_tokens: DataFrame, n_chunks: int) -> DataFrame:
    """Combine chunk tables for each fold's training chunks: ``(fold, token_id, value)``.

    Values are weighted with the chunks' token totals ``(chunk_id, tokens)``. The
    fan-out touches norm tables (chunks x vocabulary rows) and not tokens.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda f: f != F.col("chunk_id"))
    sizes = chunk_tokens.select("chunk_id", "tokens")
    totals = sizes.withColumn("fold", F.explode(others)).groupBy("fold").agg(
        F.sum("tokens").alias("_total"))
    weighted = norm.select("chunk_id", "token_id", "value").join(small(sizes, n_chunks), "chunk_id")
    summed = weighted.withColumn("fold", F.explode(others)).groupBy("fold", "token_id").agg(
        F.sum(F.col("value") * F.col("tokens")).alias("_sum"))
    return summed.join(small(totals, n_chunks), "fold").select(
        "fold", "token_id", (F.col("_sum") / F.col("_total")).alias("value"))


def norm_lookup(scores: DataFrame, norms: DataFrame, n_folds: int = params.N_CHUNKS) -> DataFrame:
    """Add each token's ``norm`` in its fold; unseen tokens get half the fold's minimum.

    ``scores`` have a row a token and fold, or are documents as :func:`norm_arrays` takes them: these
    give their tokens' rows of all folds, and only distinct tokens meet the norms.
    """
    if "input_ids" in scores.columns:
        rows = norm_arrays(scores, norms, n_folds)
        return rows.select(*[c for c in rows.columns if c != "norms"], F.posexplode("norms").alias("fold", "norm"))
    floor = norms.groupBy("fold").agg((F.min("value") / 2).alias("_floor"))
    table = norms.select("fold", "token_id", F.col("value").alias("_value"))
    rows = lookup(scores, table, ["token_id", "fold"], ["_value"], ["doc_id", "pos"], norms.count())
    return rows.join(small(floor, n_folds), "fold").withColumn(
        "norm", F.coalesce("_value", "_floor")).drop("_value", "_floor")


def norm_arrays(scores: DataFrame, norms: DataFrame, n_folds: int, context: int = params.CONTEXT,
                stride: int = params.STRIDE) -> DataFrame:
    """Add ``norms``, the norm of each fold as an array, without multiplying rows.

    The table of tokens is counted, and broadcast only where it is small; else hot
    tokens are, by their number of scores. Documents as arrays (of
    :func:`~inkprobe.operators.scoring.score_documents`, stored) give the rows of their scored tokens,
    and only the distinct tokens of each block meet the table.
    """
    folds = range(n_folds)
    pick = lambda f: F.when(F.col("fold") == f, F.col("value"))
    if "input_ids" in scores.columns:
        found, names = _norm_documents(scores, norms, n_folds)
        keep = [c for c in ("chunk_id", "label") if c in scores.columns]
        rows = sc.scored_rows(found, keep, context, stride, names)
        return rows.select(*[c for c in rows.columns if c not in names], F.array(*names).alias("norms"))
    floors = norms.agg(F.array(*[F.min(pick(f)) / 2 for f in folds])).scalar()
    wide = norms.groupBy("token_id").agg(F.array(*[F.max(pick(f)) for f in folds]).alias("_norms"))
    none = F.array(*[F.lit(None).cast("double") for _ in folds])
    wide = materialize(wide, "wide_norms")
    rows = lookup(scores, wide, ["token_id"], ["_norms"], ["doc_id", "pos"], wide.count(),
                  row_bytes=48 + 8 * n_folds).withColumn("_floors", floors)
    filled = F.zip_with(F.coalesce("_norms", none), F.col("_floors"), lambda v, f: F.coalesce(v, f))
    return rows.select(*scores.columns, filled.alias("norms"))


def _norm_documents(docs: DataFrame, norms: DataFrame, n_folds: int, drop: Sequence[str] = (),
                    finish: Callable[[pa.Table, list[np.ndarray]], dict[str, pa.Array]] | None = None,
                    made: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Documents with an array of norms a fold, or with the arrays ``made`` that ``finish`` gives for these."""
    names = [f"_norm_{f}" for f in range(n_folds)]
    pick = lambda f: F.when(F.col("fold") == f, F.col("value"))
    flat = materialize(norms.groupBy("token_id").agg(*[F.max(pick(f)).alias(c) for f, c in enumerate(names)]), "wide_norms")
    lowest = flat.agg(*[(F.min(c) / 2).alias(c) for c in names]).first()
    floors = [float("nan") if v is None else v for v in lowest]

    def fill(table: pa.Table) -> dict[str, pa.Array]:
        found = [flat_of(table.column(c))[1].to_numpy(zero_copy_only=False) for c in names]
        filled = [np.where(np.isnan(v), low, v) for v, low in zip(found, floors)]
        if finish is not None:
            return finish(table, filled)
        offsets = flat_of(table.column("input_ids"))[0]
        return {c: of_lists(offsets, pa.array(v, mask=np.isnan(v))) for c, v in zip(names, filled)}

    made = list(names if made is None else made)
    return look_up(docs, [Find("input_ids", flat, "token_id", {c: c for c in names})], drop, fill, T.StructType([
        T.StructField(c, T.ArrayType(T.IntegerType() if c == "pos" else T.DoubleType())) for c in made])), made


def value_documents(docs: DataFrame, norms: DataFrame, kind: str, n_folds: int, context: int = params.CONTEXT,
                    stride: int = params.STRIDE) -> DataFrame:
    """Documents of :func:`~inkprobe.operators.scoring.score_documents` with ``pos``, their scored tokens, and
    ``v_<fold>``, the normalised values of these, as :func:`normalize_folds` gives them token by token."""
    if kind not in ("ratio", "diff_max_token_proba"):
        raise ValueError(f"no such normalisation by norms: {kind!r}")

    def values(table: pa.Table, norms: list[np.ndarray]) -> dict[str, pa.Array]:
        offsets, nll = flat_of(table.column("nll"))
        nll, sizes = nll.to_numpy(zero_copy_only=False), np.diff(offsets)
        pos = ranges(np.zeros(len(sizes), np.int64), sizes)
        scored = tk.is_scored(pos, np.repeat(sizes, sizes), context, stride)
        ends = np.concatenate([[0], np.cumsum(scored)])[offsets]
        with np.errstate(all="ignore"):
            p = np.exp(-nll)
            if kind == "diff_max_token_proba":
                best = flat_of(table.column("max_p"))[1].to_numpy(zero_copy_only=False)
                p = 1 - (best - p)
            out = {"pos": of_lists(ends, pa.array(pos[scored].astype(np.int32)))}
            for f, norm in enumerate(norms):
                value = -np.log(p / norm)
                known = ~(np.isnan(p) | np.isnan(norm))
                value = np.where(np.isfinite(value), value, params.GUARD_VALUE)[scored]
                out[f"v_{f}"] = of_lists(ends, pa.array(value, mask=~known[scored]))
        return out

    return _norm_documents(docs, norms, n_folds, ("input_ids", "nll", "max_p"), values,
                           ["pos", *[f"v_{f}" for f in range(n_folds)]])[0]


def plain_documents(docs: DataFrame, by: Sequence[str], context: int = params.CONTEXT, stride: int = params.STRIDE) -> DataFrame:
    """Documents of :func:`~inkprobe.operators.scoring.score_documents` as ``(*by, v)``, the losses of their scored tokens; narrow."""
    schema = T.StructType([*[docs.schema[c] for c in by], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, "nll")):
            offsets, nll = flat_of(batch.column("nll"))
            sizes = np.diff(offsets)
            there = tk.is_scored(ranges(np.zeros(len(sizes), np.int64), sizes), np.repeat(sizes, sizes), context, stride)
            ends = np.concatenate([[0], np.cumsum(there)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in by], of_lists(ends, nll.filter(pa.array(there)))], names=[*by, "v"])

    return docs.select(*by, "nll").mapInArrow(scored, schema)


def _guarded(known: Column, value: Column) -> Column:
    """``value``, or the fixed guard where it is undefined, NaN or infinite.

    NULL stands for an undefined logarithm only where all inputs are ``known``.
    """
    bad = (known & value.isNull()) | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(params.GUARD_VALUE)).otherwise(value)


def ratio(nll: Column, norm: Column) -> Column:
    return _guarded(nll.isNotNull() & norm.isNotNull(), -F.ln(F.try_divide(F.exp(-nll), norm)))


def diff_max(nll: Column, max_p: Column, norm: Column) -> Column:
    known = nll.isNotNull() & max_p.isNotNull() & norm.isNotNull()
    return _guarded(known, -F.ln(F.try_divide(1 - (max_p - F.exp(-nll)), norm)))


def _value(kind: str, columns: list[str], norm: Column) -> Column:
    if kind == "none":
        return F.col("nll")
    if kind == "ratio":
        return ratio(F.col("nll"), norm)
    if kind == "diff_max_token_proba":
        best = F.col("max_p") if "max_p" in columns else F.array_max(F.map_values("top"))
        return diff_max(F.col("nll"), best, norm)
    raise ValueError(f"no such normalisation: {kind!r}; known are {', '.join(KINDS)}")


def normalize(scores: DataFrame, kind: str) -> DataFrame:
    """Add ``value``; needs ``norm`` for ratio kinds and ``max_p`` or ``top`` for diff-max."""
    return scores.withColumn("value", _value(kind, scores.columns, F.col("norm")))


def normalize_folds(scores: DataFrame, kind: str, n_folds: int) -> DataFrame:
    """Add ``values``, one normalised value per fold, from :func:`norm_arrays` rows."""
    each = [_value(kind, scores.columns, F.col("norms")[f] if kind != "none" else None)
            for f in range(n_folds)]
    return scores.withColumn("values", F.array(*each))
