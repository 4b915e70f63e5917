"""Membership scores of single windows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe import params
from inkprobe.functions.blocks import flat_of, of_lists, ranges, repeated, with_keys
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk


@F.pandas_udf(T.IntegerType())
def zlib_len(text: pd.Series) -> pd.Series:
    """Compressed size of each text; Spark has no built-in compressor."""
    return text.map(lambda t: None if t is None else len(zlib.compress(t.encode("utf-8"))))


def min_k_name(ratio: float) -> str:
    return f"min_{int(ratio * 100)}"


def min_k(sorted_logp: Column, ratio: float) -> Column:
    """Minus the mean of the lowest int(n * ratio) log-probabilities; NULL for none."""
    k = F.floor(F.size(sorted_logp) * F.lit(ratio)).cast("int")
    total = F.aggregate(F.slice(sorted_logp, F.lit(1), k), F.lit(0.0), lambda a, x: a + x)
    return F.when(k > 0, -total / k)


LOSSES = {"nll": "loss", "nll_ref": "loss_ref", "nll_low": "loss_lower"}


def _windows(docs: pa.Table, context: int, stride: int) -> pa.Table:
    """The windows of whole documents with what :func:`window_losses` says of them."""
    offsets, ids = flat_of(docs.column("input_ids"))
    sizes = np.diff(offsets)
    n_windows = -(-sizes // stride)
    doc = np.repeat(np.arange(len(sizes)), n_windows)
    begin = ranges(np.zeros(len(sizes), np.int64), n_windows) * stride
    lengths = np.minimum(context, sizes[doc] - begin)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    place = ranges(offsets[:-1][doc] + begin, lengths)
    listed = lambda flat: of_lists(ends, flat.take(pa.array(place)))
    window = np.repeat(np.arange(len(doc)), lengths)
    scored = np.ones(len(place), bool)
    scored[ends[:-1]] = False
    out = [docs.column("doc_id").take(pa.array(doc)), pa.array(begin.astype(np.int32)), pa.array(lengths - 1)]
    for name in LOSSES:
        values = flat_of(docs.column(name))[1].to_numpy(zero_copy_only=False)[place]
        there = scored & ~np.isnan(values)
        own, value = window[there], values[there]
        n = np.bincount(own, minlength=len(doc))
        out.append(pa.array(np.bincount(own, value, len(doc)) / np.maximum(n, 1), mask=n == 0))
        if name == "nll":
            lowest = of_lists(np.concatenate([[0], np.cumsum(n)]), pa.array(-value[np.lexsort((-value, own))]))
    out += [lowest, listed(ids)]
    names = ["doc_id", "begin", "n", *LOSSES.values(), "logp", "sequence"]
    if "words" in docs.column_names:
        out.append(listed(flat_of(docs.column("words"))[1]))
        names.append("words")
    return pa.table(out, names=names)


def window_losses(tokens: DataFrame, model: sc.CountModel, context: int = params.CONTEXT,
                  stride: int = params.STRIDE) -> DataFrame:
    """Per window ``(doc_id, begin)``: losses and what the scores are made of.

    ``model`` has the pools target and reference; ``tokens`` are documents of
    :func:`~inkprobe.operators.tokens.encode` with the lower-cased ids, and with ``words`` where these are asked for. Each block of
    documents asks the model for its distinct pairs, plain and lower-cased, and windows are
    cut out of the documents' own arrays there. Only documents that share their id are put together by a shuffle.
    """
    wanted = {"input_ids": {"target": "nll", "reference": "nll_ref"}, "low_ids": {"target": "nll_low"}}
    words = [c for c in ("words",) if c in tokens.columns]
    shared = repeated(tokens.select("doc_id"), ["doc_id"])
    single = tokens if shared is None else with_keys(tokens, shared, ["doc_id"], "left_anti")
    schema = T.StructType([tokens.schema["doc_id"], *T._parse_datatype_string(
        "begin int, n bigint, loss double, loss_ref double, loss_lower double, logp array<double>, sequence array<int>"
        + (", words array<string>" if words else ""))])
    windows = sc.document_losses(single, model, wanted, turn=(lambda docs: _windows(docs, context, stride), schema))
    if shared is None:
        return windows
    found = sc.document_losses(with_keys(tokens, shared, ["doc_id"], "left_semi"), model, wanted)
    rows = tk.explode_windows(tk.token_rows(found, extra={c: F.col(c) for c in LOSSES}), context, stride)
    scored = F.col("pos") > F.col("begin")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda e: e[c])
    return windows.unionByName(rows.groupBy("doc_id", "begin").agg(
        F.count(F.when(scored, 1)).alias("n"),
        *[F.avg(F.when(scored, F.col(c))).alias(out) for c, out in LOSSES.items()],
        F.sort_array(F.collect_list(F.when(scored, -F.col("nll")))).alias("logp"),
        listed("token_id").alias("sequence"), *[listed("word").alias("words") for _ in words]))


def score_table(windows: DataFrame, with_zlib: bool = True) -> DataFrame:
    """Wide scores per window, ``doc_id`` as 'doc_<id>', from :func:`window_losses`."""
    cols = [
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"), "begin",
        "sequence",
        F.exp("loss").alias("ppl"),
        (F.col("loss") - F.col("loss_ref")).alias("ref_diff"),
        (-F.try_divide(F.col("loss_lower"), F.col("loss"))).alias("lower_ratio"),
    ]
    if with_zlib:
        text = F.array_join("words", " ")
        cols.append(F.try_divide(F.col("loss"), zlib_len(text)).alias("zlib_ratio"))
    cols += [min_k(F.col("logp"), r).alias(min_k_name(r)) for r in params.MIN_K_RATIOS]
    return windows.select(*cols)


def report(scores: DataFrame) -> DataFrame:
    """The score table under its report column names."""
    return scores.withColumnsRenamed(params.REPORT_NAMES)
