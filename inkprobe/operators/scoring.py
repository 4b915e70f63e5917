"""Count-based language models and token scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe import params
from inkprobe.functions.blocks import (
    BLOCK,
    Find,
    flat_of,
    look_up,
    of_lists,
    pair_key,
    ranges,
    repeated,
    sliced,
    whole_numbers,
    with_keys,
)
from inkprobe.functions.skew import lookup, lookup_join
from inkprobe.operators import tokens as tk
from inkprobe.session import materialize, small

HELD_PAIRS = 3_000_000  # tokens whose pairs a task counts at a time

TOKEN_SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("token_id", T.IntegerType()),
    T.StructField("nll", T.DoubleType()),
    T.StructField("top", T.MapType(T.IntegerType(), T.DoubleType())),
])


@dataclass(frozen=True)
class CountModel:
    """p(t | ctx) = b(ctx, t) + keep(ctx) * u(t), one set of columns per training pool.

    ``terms``     (*ctx, token_id, n, b_<pool>): pairs seen in training
    ``contexts``  (*ctx, keep_<pool>, pairs, c_<pool>): contexts seen in training, how many terms and tokens each has
    ``unigrams``  (token_id, u_<pool>): the whole vocabulary and the unknown id
    ``counts``    (*ctx, token_id, n_<pool>): the same pairs as counted, b_<pool> = lam * n_<pool> / c_<pool>
    """

    terms: DataFrame
    contexts: DataFrame
    unigrams: DataFrame
    ctx: tuple[str, ...]
    pools: tuple[str, ...]
    size: int  # rows of ``unigrams``, counted
    counts: DataFrame
    lam: float

    @property
    def max_contexts(self) -> int | None:
        """Row bound of ``contexts``: one context token means at most the vocabulary."""
        return self.size if len(self.ctx) == 1 else None


Keyed = tuple[list[np.ndarray], np.ndarray]  # columns of ids, and a row of counts a pool


def _added(parts: Sequence[Keyed]) -> Keyed:
    """Distinct ids in order, and the sums of their counts."""
    columns = [np.concatenate(c).astype(np.int32, copy=False) for c in zip(*[k for k, _ in parts])]
    counts = np.concatenate([n for _, n in parts], axis=1)
    paired = lambda high, low: (high.astype(np.int64) << 32) | low
    keys = paired(columns[0], columns[1])
    if len(columns) == 3:  # the first two become the number of their pair
        firsts, place = np.unique(keys, return_inverse=True)
        keys = paired(place, columns[2])
        del place
    keys, place = np.unique(keys, return_inverse=True)
    sums = np.stack([np.bincount(place, n, len(keys)) for n in counts]).astype(np.int64)
    high, low = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)
    if len(columns) == 2:
        return [high, low], sums
    firsts = firsts[high]
    return [(firsts >> 32).astype(np.int32), (firsts & 0xFFFFFFFF).astype(np.int32), low], sums


def added_up(parts: Iterable[Keyed], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Two or three columns of ids and their counts, added up by task; ``names`` those of both."""
    held, size = [], 0

    def sent(columns: list[np.ndarray], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c[own].astype(np.int32)) for c in columns], *[pa.array(n[own]) for n in sums]],
                names=list(names))

    for part in parts:
        held.append(_added([part]))
        size += len(held[-1][0][0])
        if size > HELD_PAIRS:
            held = [_added(held)]
            size = len(held[0][0][0])
            if size > HELD_PAIRS // 2:
                yield from sent(*held[0])
                held, size = [], 0
    if held:
        yield from sent(*_added(held))


def neighbours_of(offsets: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """``prev`` and ``next`` of each id in its document."""
    filled = offsets[:-1] < offsets[1:]
    before, after = np.concatenate([[params.BOS], ids[:-1]]), np.concatenate([ids[1:], [params.EOS]])
    before[offsets[:-1][filled]] = params.BOS
    after[offsets[1:][filled] - 1] = params.EOS
    return {"prev": before, "next": after}


def _counted(batches: Iterable[pa.RecordBatch], ctx: Sequence[str], n_pools: int) -> Iterator[pa.RecordBatch]:
    """Contexts and tokens of documents and how often each pool has them, added up by task."""
    def parts() -> Iterator[Keyed]:
        for batch in batches:
            for own in sliced(batch, 0):
                offsets, flat = flat_of(own.column(0))
                ids = whole_numbers(flat)
                if not len(ids):
                    continue
                beside, sizes = neighbours_of(offsets, ids), np.diff(offsets)
                yield [*[beside[c] for c in ctx], ids], np.stack([
                    np.repeat(own.column(1 + k).to_numpy(zero_copy_only=False), sizes) for k in range(n_pools)])

    return added_up(parts(), [*ctx, "token_id", *[f"_n{k}" for k in range(n_pools)]])


def count_pairs(tokens: DataFrame, pools: Mapping[str, Column], ctx: Sequence[str]) -> DataFrame:
    """``(*ctx, token_id, n_<pool>)`` of the tokens that some pool has.

    Tokens are long, or documents of :func:`~inkprobe.operators.tokens.encode`, which count the pairs of the
    contexts ``prev`` or ``prev``, ``next`` where they lie and send each pair of a task once.
    """
    used = reduce(lambda a, b: a | b, pools.values())
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    if "input_ids" not in tokens.columns:
        return tokens.filter(used).groupBy(*ctx, "token_id").agg(
            *[F.sum(flag(cond)).alias(f"n_{p}") for p, cond in pools.items()])
    if list(ctx) not in (["prev"], ["prev", "next"]):
        raise ValueError("documents give pairs of the token before, or of both neighbours")
    rows = tokens.filter(used).select("input_ids", *[flag(c).alias(f"_is{k}") for k, c in enumerate(pools.values())])
    n = len(pools)
    schema = ", ".join([*[f"{c} int" for c in (*ctx, "token_id")], *[f"_n{k} bigint" for k in range(n)]])
    counted = rows.mapInArrow(lambda batches: _counted(batches, list(ctx), n), schema)
    return counted.groupBy(*ctx, "token_id").agg(*[F.sum(f"_n{k}").alias(f"n_{p}") for k, p in enumerate(pools)])


def _listed_by_context(tokens: DataFrame, pools: Mapping[str, Column],
                       ctx: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`count_pairs` of documents, and ``(*ctx, c_<pool>, pairs)``, both narrow over a stored table.

    The table has a row a context, with the tokens seen in it and their counts as arrays: pairs meet by
    their two context tokens, of which no two stand around many of all tokens, and are not shuffled again for totals.
    """
    names = [f"n_{p}" for p in pools]
    used = reduce(lambda a, b: a | b, pools.values())
    rows = tokens.filter(used).select("input_ids", *[
        F.when(c, 1).otherwise(0).alias(f"_is{k}") for k, c in enumerate(pools.values())])
    schema = ", ".join([*[f"{c} int" for c in (*ctx, "token_id")], *[f"{n} bigint" for n in names]])
    counted = rows.mapInArrow(lambda batches: (
        b.rename_columns([*ctx, "token_id", *names]) for b in _counted(batches, list(ctx), len(names))), schema)
    summed = counted.repartition(*ctx).groupBy(*ctx, "token_id").agg(*[F.sum(n).alias(n) for n in names])
    lists = materialize(summed.groupBy(*ctx).agg(
        F.collect_list(F.struct("token_id", *names)).alias("_t")).select(
        *ctx, *[F.col("_t")[c].alias(c) for c in ("token_id", *names)]), "pair_lists")
    pairs = lists.select(*ctx, F.explode(F.arrays_zip("token_id", *names)).alias("_t")).select(*ctx, "_t.*")
    total = lambda n: F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return pairs, lists.select(*ctx, *[total(f"n_{p}").alias(f"c_{p}") for p in pools],
                               F.size("token_id").cast("bigint").alias("pairs"))


def train(tokens: DataFrame, vocab: DataFrame, pools: Mapping[str, Column],
          ctx: Sequence[str] = ("prev",), lam: float = params.LAMBDA, store: bool = False) -> CountModel:
    """Count every pool in one scan and one shuffle of partly aggregated pairs.

    The vocabulary is counted, and what is no longer than it gets broadcast only
    where that number is low. ``store`` writes the counts and the two small tables to the shared folder;
    without it every use of the model counts again. ``tokens`` as :func:`count_pairs` takes them.
    """
    hold = materialize if store else (lambda df, name: df)
    size = vocab.count() + params.N_RESERVED
    ctx = list(ctx)
    if store and len(ctx) > 1 and "input_ids" in tokens.columns:
        pairs, contexts = _listed_by_context(tokens, pools, ctx)
    else:
        pairs = hold(count_pairs(tokens, pools, ctx), "pairs")
        contexts = hold(pairs.groupBy(*ctx).agg(
            *[F.sum(f"n_{p}").alias(f"c_{p}") for p in pools], F.count("*").alias("pairs")), "contexts")
    seen = lambda p: F.col(f"c_{p}") > 0
    bound = size if len(ctx) == 1 else None
    summed = lookup(pairs, contexts, ctx, [f"c_{p}" for p in pools], ["token_id"], bound, contexts, "pairs")
    terms = summed.select(
        *ctx, "token_id",
        F.greatest(*[F.col(f"n_{p}") for p in pools], F.lit(0)).alias("n"),
        *[F.when(seen(p), lam * F.col(f"n_{p}") / F.col(f"c_{p}")).otherwise(F.lit(0.0)).alias(f"b_{p}")
          for p in pools])
    contexts = contexts.select(
        *ctx, *[F.when(seen(p), F.lit(1 - lam)).otherwise(F.lit(1.0)).alias(f"keep_{p}") for p in pools], "pairs",
        *[f"c_{p}" for p in pools])

    counts = pairs.groupBy("token_id").agg(*[F.sum(f"n_{p}").alias(f"n_{p}") for p in pools])
    every = vocab.select("token_id").union(
        vocab.sparkSession.range(1).select(F.lit(params.UNK).alias("token_id")))
    joined = every.join(small(counts, size), "token_id", "left")
    totals = joined.agg(
        F.count("*").alias("types"),
        *[F.sum(F.coalesce(f"n_{p}", F.lit(0))).alias(f"N_{p}") for p in pools])
    denom = {p: totals.select((F.col(f"N_{p}") + F.col("types")).cast("double")).scalar()
             for p in pools}
    unigrams = joined.select(
        "token_id",
        *[((F.coalesce(f"n_{p}", F.lit(0)) + 1) / denom[p]).alias(f"u_{p}") for p in pools])
    return CountModel(terms, contexts, hold(unigrams, "unigrams"), tuple(ctx), tuple(pools), size, pairs, lam)


def attach_nll(rows: DataFrame, model: CountModel, spread: Sequence[str],
               names: Mapping[str, str] | None = None, extra: DataFrame | None = None,
               value: str = "") -> DataFrame:
    """Add the loss of ``token_id`` after the row's context, one column per pool.

    The model meets each distinct pair once, and the rows then look up their
    pair, whose number of rows is known by then: so no join meets a hot token or
    context. ``extra`` (*ctx, ``value``) is looked up on the way.
    """
    names = names or {model.pools[0]: "nll"}
    ctx = list(model.ctx)
    keys = [*ctx, "token_id"]
    pairs = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "asked_pairs")
    met = pairs.join(model.terms.select(*keys, *[f"b_{p}" for p in names]), keys, "left")
    met = lookup(met, model.contexts, ctx, [f"keep_{p}" for p in names], ["token_id"], model.max_contexts)
    met = lookup(met, model.unigrams, ["token_id"], [f"u_{p}" for p in names], ctx, model.size)
    values = list(names.values())
    if extra is not None:
        met = lookup(met, extra, ctx, [value], ["token_id"], model.max_contexts)
        values.append(value)
    scored = materialize(met.select(*keys, "_n", *[
        (-F.ln(F.coalesce(f"b_{p}", F.lit(0.0))
               + F.coalesce(f"keep_{p}", F.lit(1.0)) * F.col(f"u_{p}"))).alias(out)
        for p, out in names.items()], *([value] if extra is not None else [])), "pair_scores")
    return lookup_join(rows, scored, keys, values, spread, scored, "_n")


def _losses(table: pa.Table, ids: Mapping[str, Mapping[str, str]], lam: float, best: bool,
            floor: float) -> dict[str, pa.Array]:
    """Losses of a block's tokens from their counts and the unigrams; NULL for the first of a document."""
    out = {}
    for name, wanted in ids.items():
        offsets, flat = flat_of(table.column(name))
        first = np.zeros(len(flat), bool)
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        part = lambda kind, p: flat_of(table.column(f"_{kind}_{p}_{name}"))[1].to_numpy(zero_copy_only=False)
        before = lambda v: np.concatenate([v[:1], v[:-1]])
        for pool, made in wanted.items():
            c, n, u = before(part("c", pool)), part("n", pool), part("u", pool)
            with np.errstate(divide="ignore", invalid="ignore"):
                b, keep = lam * n / c, np.where(c > 0, 1 - lam, 1.0)
                p = np.where((c > 0) & ~np.isnan(n), b, 0.0) + keep * u
                out[made] = of_lists(offsets, pa.array(-np.log(p), mask=first | ~(p > 0)))
        if best and name == "input_ids":
            most = before(flat_of(table.column("_most_input_ids"))[1].to_numpy(zero_copy_only=False))
            out["max_p"] = of_lists(offsets, pa.array(np.where(first | np.isnan(most), floor, most)))
    return out


def document_losses(corpus: DataFrame, model: CountModel, ids: Mapping[str, Mapping[str, str]] | None = None,
                    max_p: bool = False, turn: tuple[Callable[[pa.Table], pa.Table], T.StructType] | None = None) -> DataFrame:
    """``corpus`` with the losses of its tokens as arrays, NULL for the first token of a document.

    ``ids`` maps each array of ids to the pools wanted of it and the arrays these become (the first pool of ``input_ids``
    becomes ``nll``). Blocks of documents ask for their distinct tokens and pairs. ``max_p`` adds the
    highest next-token probability (:func:`max_probs`). ``turn`` makes other rows of these where they
    arise (:func:`~inkprobe.functions.blocks.look_up`).
    """
    ids = ids or {"input_ids": {model.pools[0]: "nll"}}
    pools = sorted({p for wanted in ids.values() for p in wanted})
    ctx, lam = model.ctx[0], model.lam
    about = model.unigrams.select("token_id", *[f"u_{p}" for p in pools]).join(
        model.contexts.select(F.col(ctx).alias("token_id"), *[f"c_{p}" for p in pools]), "token_id", "left")
    floor = 0.0
    if max_p:
        best, _ = max_probs(model)
        floor = model.unigrams.agg(F.max(f"u_{model.pools[0]}")).first()[0] or 0.0
        about = about.join(best.select(F.col(ctx).alias("token_id"), "max_p"), "token_id", "left")
    about = materialize(about, "token_facts")
    # Counts as they were stored: a block knows its contexts' totals, so no pair meets its context before.
    pairs = model.counts.select(pair_key(F.col(ctx), F.col("token_id")).alias("pair"), *[f"n_{p}" for p in pools])
    made = [c for wanted in ids.values() for c in wanted.values()]
    values = {f"{kind}_{p}": f"_{kind}_{p}_" for p in pools for kind in ("u", "c")}
    if max_p:
        values["max_p"] = "_most_"
        made.append("max_p")
    finds = [Find(tuple(ids), about, "token_id", values),
             Find(tuple(ids), pairs, "pair", {f"n_{p}": f"_n_{p}_" for p in pools}, pairs=True)]
    return look_up(corpus, finds, finish=lambda table: _losses(table, ids, lam, max_p, floor), finished=T.StructType([
        T.StructField(c, T.ArrayType(T.DoubleType())) for c in made]), turn=turn)


def score_documents(corpus: DataFrame, model: CountModel, max_p: bool = False) -> DataFrame:
    """``corpus`` with the array ``nll``, the loss of every token but the first, and with ``max_p``.

    ``max_p`` asks for the highest next-token probability (:func:`max_probs`).
    """
    return document_losses(corpus, model, max_p=max_p)


def scored_rows(scored: DataFrame, keep: Sequence[str] = (), context: int = params.CONTEXT,
                stride: int = params.STRIDE, arrays: Sequence[str] = ()) -> DataFrame:
    """One row a position that some window scores, of :func:`score_documents`, with further ``arrays``; narrow."""
    extra = {c: F.col(c) for c in ("nll", "max_p", *arrays) if c in scored.columns}
    return tk.token_rows(scored, keep, extra=extra).filter(tk.scoring_begin(context, stride).isNotNull())


def score_tokens(tokens: DataFrame, model: CountModel, context: int = params.CONTEXT,
                 stride: int = params.STRIDE, max_p: bool = False) -> DataFrame:
    """Loss of every position some window scores; the last window counts.

    ``tokens`` are long, or documents of :func:`~inkprobe.operators.tokens.encode`, whose
    tokens then stay with them (:func:`score_documents`). ``max_p`` adds the highest next-token
    probability (:func:`max_probs`).

    The window that counts follows from the position alone, so no overlap has to
    be resolved by a shuffle.
    """
    if "input_ids" in tokens.columns and len(model.ctx) == 1:
        keep = [c for c in tokens.columns if c not in ("_block", "doc_id", "input_ids", "low_ids", "words")]
        return scored_rows(score_documents(tokens.select("_block", "doc_id", *keep, "input_ids"), model, max_p),
                           keep, context, stride)
    scored = tokens.filter(tk.scoring_begin(context, stride).isNotNull())
    if not max_p:
        return attach_nll(scored, model, ["doc_id", "pos"])
    best, floor = max_probs(model)
    rows = attach_nll(scored, model, ["doc_id", "pos"], extra=best, value="max_p")
    return rows.withColumn("max_p", F.coalesce("max_p", floor))


def resolve_overlaps(window_scores: DataFrame, value: str = "nll") -> DataFrame:
    """One value per position from windowed scores: that of the last window."""
    return window_scores.groupBy("doc_id", "pos").agg(
        F.max_by(value, "begin").alias(value), F.max("begin").alias("begin"))


def resolve_documents(corpus: DataFrame, model: CountModel, value: Callable[[Column], Column],
                      context: int = params.CONTEXT, stride: int = params.STRIDE) -> DataFrame:
    """:func:`resolve_overlaps` of the windows of documents as arrays (of :func:`~inkprobe.operators.tokens.encode`).

    ``value`` gives a position's score in the window that begins at its argument, from ``pos`` and ``nll``. A
    position's windows meet in its own row; only documents that share their id are put together by a shuffle.
    """
    def resolved(docs: DataFrame) -> DataFrame:
        begins = F.filter(tk.covering_begins(context, stride, early_stop=True), lambda b: b < F.col("pos"))
        windows = F.transform(begins, lambda b: F.struct(b.alias("begin"), value(b).alias("nll")))
        rows = score_tokens(docs, model).select("doc_id", "pos", F.array_max(windows).alias("_w"))
        return rows.filter(F.col("_w").isNotNull()).select("doc_id", "pos", "_w.nll", "_w.begin")

    shared = repeated(corpus, ["doc_id"])
    if shared is None:
        return resolved(corpus)
    several = resolve_overlaps(resolved(with_keys(corpus, shared, ["doc_id"], "left_semi")))
    return resolved(with_keys(corpus, shared, ["doc_id"], "left_anti")).unionByName(several)


def with_rank(scores: DataFrame) -> DataFrame:
    """The rank column is part of the score schema but never computed."""
    return scores.withColumn("rank", F.lit(None).cast("int"))


def doc_perplexity(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy("doc_id", *by).agg(
        F.exp(F.avg("nll")).alias("perplexity"), F.count("nll").alias("n_scored"))


# -------------------------------------------------------- top-k per context

def top_unigrams(model: CountModel, k: int, pool: str | None = None) -> Column:
    """The k likeliest tokens without context, as one array of (token_id, p)."""
    u = f"u_{pool or model.pools[0]}"
    best = model.unigrams.orderBy(F.desc(u), "token_id").limit(k)
    packed = F.sort_array(F.collect_list(F.struct((-F.col(u)).alias("neg"), F.col("token_id"))))
    return best.agg(F.transform(packed, lambda t: F.struct(
        t["token_id"].alias("token_id"), (-t["neg"]).alias("p")))).scalar()


def next_probs(model: CountModel, pool: str, terms: DataFrame | None = None) -> DataFrame:
    """(*ctx, token_id, keep, p) of the pairs seen in training."""
    ctx = list(model.ctx)
    keep, c = f"keep_{pool}", f"c_{pool}"
    share = F.when(F.col(c) > 0, model.lam * F.col(f"n_{pool}") / F.col(c)).otherwise(F.lit(0.0))
    # Pairs as counted get their context's total with what it keeps, and so meet it once.
    part, b, facts = (model.counts, f"n_{pool}", [keep, c]) if terms is None else (terms, f"b_{pool}", [keep])
    seen = lookup(part.select(*ctx, "token_id", b), model.unigrams, ["token_id"], [f"u_{pool}"], ctx, model.size)
    seen = lookup(seen, model.contexts, ctx, facts, ["token_id"], model.max_contexts,
                  model.contexts if terms is None else None, "pairs")
    return seen.select(*ctx, "token_id", F.col(keep).alias("keep"), (
        (share if terms is None else F.col(b)) + F.col(keep) * F.col(f"u_{pool}")).alias("p"))


def top_lists(model: CountModel, k: int = params.TOP_K, pool: str | None = None,
              asked: DataFrame | None = None) -> DataFrame:
    """The k likeliest next tokens of every seen context, as one array ``top`` of (token_id, p).

    Seen tokens are cut to their k best first. Tokens unseen after a context keep
    their unigram order, so the k best unigrams complete the list exactly, and
    no context x vocabulary product is formed. ``asked`` (distinct contexts) limits
    the work to these.
    """
    pool = pool or model.pools[0]
    ctx = list(model.ctx)
    terms = None if asked is None else model.terms.join(asked.select(*ctx), ctx, "left_semi")
    scored = next_probs(model, pool, terms)
    order = W.partitionBy(*ctx).orderBy(F.desc("p"), "token_id")
    cut = scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    packed = cut.groupBy(*ctx).agg(
        F.collect_list(F.struct((-F.col("p")).alias("neg"), "token_id")).alias("_s"),
        F.max("keep").alias("_keep")).withColumn("_best", top_unigrams(model, k, pool))
    known = F.transform("_s", lambda e: e["token_id"])
    packed = packed.withColumn("_known", known)
    filler = F.transform(
        F.filter("_best", lambda e: ~F.array_contains("_known", e["token_id"])),
        lambda e: F.struct((-(F.col("_keep") * e["p"])).alias("neg"), e["token_id"].alias("token_id")))
    top = F.slice(F.sort_array(F.concat("_s", filler)), 1, k)
    return packed.select(*ctx, F.transform(top, lambda e: F.struct(
        e["token_id"].alias("token_id"), (-e["neg"]).alias("p"))).alias("top"))


def top_candidates(model: CountModel, k: int = params.TOP_K, pool: str | None = None) -> DataFrame:
    """:func:`top_lists` in long form: ``(*ctx, rank, token_id, p)``."""
    lists = top_lists(model, k, pool)
    return lists.select(*model.ctx, F.posexplode("top").alias("_i", "_t")).select(
        *model.ctx, (F.col("_i") + 1).alias("rank"), "_t.token_id", "_t.p")


def with_top_probs(scores: DataFrame, model: CountModel, k: int = params.TOP_K,
                   pool: str | None = None) -> DataFrame:
    """Add the map ``top`` of the k likeliest tokens at each position."""
    lists = materialize(top_lists(model, k, pool), "top_lists")
    joined = lookup(scores, lists, list(model.ctx), ["top"], ["doc_id", "pos"], model.max_contexts, row_bytes=32 * k)
    filled = joined.withColumn("top", F.coalesce("top", top_unigrams(model, k, pool)))
    return filled.withColumn("top", F.map_from_entries("top"))


def max_probs(model: CountModel, pool: str | None = None) -> tuple[DataFrame, Column]:
    """(*ctx, max_p) of the seen contexts, stored, and the value of all others.

    The highest next-token probability belongs to a seen token or to the likeliest unigram.
    """
    pool = pool or model.pools[0]
    top_u = model.unigrams.agg(F.max(f"u_{pool}")).scalar()
    best = next_probs(model, pool).groupBy(*model.ctx).agg(F.max("p").alias("_seen"), F.max("keep").alias("_keep"))
    best = best.withColumn("_top_u", top_u).select(
        *model.ctx, F.greatest("_seen", F.col("_keep") * F.col("_top_u")).alias("max_p"))
    return materialize(best, "max_probs"), top_u


def with_max_p(scores: DataFrame, model: CountModel, pool: str | None = None) -> DataFrame:
    """Add ``max_p``, the highest next-token probability at each position."""
    best, floor = max_probs(model, pool)
    rows = lookup(scores, best, list(model.ctx), ["max_p"], ["doc_id", "pos"], model.max_contexts)
    return rows.withColumn("max_p", F.coalesce("max_p", floor))


# ---------------------------------------------------- general probability

def _slots(batches: Iterable[pa.RecordBatch], context: int, stride: int) -> Iterator[pa.RecordBatch]:
    """Distinct contexts of each document and their slots, as arrays in place of its ids."""
    for batch in (part for whole in batches for part in sliced(whole, "input_ids")):
        offsets, flat = flat_of(batch.column("input_ids"))
        ids, sizes = whole_numbers(flat), np.diff(offsets)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pos = ranges(np.zeros(len(sizes), np.int64), sizes)
        before = np.concatenate([[params.BOS], ids[:-1]]) if len(ids) else ids
        before[pos == 0] = params.BOS
        slots = tk.slots_of(pos, sizes[doc], context, stride)
        used = slots > 0
        keys, place = np.unique((doc[used] << 32) | before[used], return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(keys >> 32, minlength=len(sizes)))])
        rest = batch.drop_columns(["input_ids"])
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(sizes.astype(np.int32)), of_lists(ends, pa.array((keys & 0xFFFFFFFF).astype(np.int32))),
             of_lists(ends, pa.array(np.bincount(place, slots[used], len(keys)).astype(np.int64)))],
            names=[*rest.schema.names, "n_tokens", "prev", "slots"])


def doc_contexts(corpus: DataFrame, by: Sequence[str] = (), context: int = params.CONTEXT,
                 stride: int = params.STRIDE) -> DataFrame:
    """:func:`doc_general_proba` of documents as arrays, a row a document: ``(_block, doc_id, *by, n_tokens, prev, slots, weight)``.

    A document's contexts are counted where it lies. Documents of one id and length count as one, as
    tokens that share these do; only they are put together by a shuffle.
    """
    keys = ["doc_id", *by, "n_tokens"]
    schema = T.StructType([corpus.schema[c] for c in (BLOCK, "doc_id", *by)] + [
        T.StructField("n_tokens", T.IntegerType()), T.StructField("prev", T.ArrayType(T.IntegerType())),
        T.StructField("slots", T.ArrayType(T.LongType()))])
    rows = corpus.select(BLOCK, "doc_id", *by, "input_ids").mapInArrow(
        lambda batches: _slots(batches, context, stride), schema)
    shared = repeated(corpus.select("doc_id", *by, F.size("input_ids").alias("n_tokens")), keys)
    if shared is not None:
        block, own = F.col(BLOCK), with_keys(rows, shared, keys, "left_semi")
        each = own.select(BLOCK, *keys, F.explode(F.arrays_zip("prev", "slots")).alias("_e"))
        merged = each.groupBy(*keys, "_e.prev").agg(F.sum("_e.slots").alias("slots"), F.min(block).alias(BLOCK))
        packed = merged.groupBy(*keys).agg(
            F.min(BLOCK).alias(BLOCK), F.sort_array(F.collect_list(F.struct("prev", "slots"))).alias("_e"))
        rows = with_keys(rows, shared, keys, "left_anti").unionByName(
            packed.select(BLOCK, *keys, F.col("_e.prev").alias("prev"), F.col("_e.slots").alias("slots")))
    total = tk.total_slots(context, stride)
    return rows.filter(F.size("prev") > 0).withColumn("_total", total).withColumn(
        "weight", F.transform("slots", lambda n: n / F.col("_total"))).drop("_total")


def doc_general_proba(tokens: DataFrame, by: Sequence[str] = (), context: int = params.CONTEXT,
                      stride: int = params.STRIDE) -> DataFrame:
    """Mean next-token distribution of each document, in factored form.

    ``weight`` is the share of the document's window slots with context
    ``prev``; the mean distribution is sum(weight * p(. | prev)). Rows grow with
    the text and not with documents x vocabulary, and the number of slots
    follows from the length. Documents as arrays are counted without a shuffle (:func:`doc_contexts`),
    long tokens by one aggregation.
    """
    if "input_ids" in tokens.columns:
        packed = doc_contexts(tokens, by, context, stride)
        return packed.select("doc_id", *by, F.explode(F.arrays_zip("prev", "slots", "weight")).alias("_e")).select(
            "doc_id", *by, "_e.prev", "_e.slots", "_e.weight")
    slots = tokens.withColumn("_s", tk.slot_count(context, stride)).filter("_s > 0")
    per = slots.groupBy("doc_id", *by, "prev", "n_tokens").agg(F.sum("_s").alias("slots"))
    return per.select("doc_id", *by, "prev", "slots",
                      (F.col("slots") / tk.total_slots(context, stride)).alias("weight"))


def _background(table: pa.Table) -> dict[str, pa.Array]:
    offsets, weight = flat_of(table.column("weight"))
    keep = flat_of(table.column("_keep"))[1].to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(table)), np.diff(offsets))
    mass = weight.to_numpy(zero_copy_only=False) * np.where(np.isnan(keep), 1.0, keep)
    return {"_mass": pa.array(np.bincount(doc, mass, len(table)))}


def doc_background(weights: DataFrame, model: CountModel, pool: str | None = None) -> DataFrame:
    """Mass of each document's mean distribution that follows the unigram table.

    ``weights`` are long, or those of :func:`doc_contexts`, whose blocks ask for their distinct contexts.
    """
    name = f"keep_{pool or model.pools[0]}"
    if BLOCK in weights.columns:
        rows = materialize(weights.select(BLOCK, "doc_id", "prev", "weight"), "doc_contexts")
        found = look_up(rows, [Find("prev", model.contexts.withColumnRenamed("prev", "_c"), "_c", {name: "_keep"})],
                        drop=("prev", "weight"), finish=_background,
                        finished=T.StructType([T.StructField("_mass", T.DoubleType())]))
        return found.groupBy("doc_id").agg(F.sum("_mass").alias("background"))
    keep = F.coalesce(name, F.lit(1.0))
    rows = lookup(weights, model.contexts, ["prev"], [name], ["doc_id"], model.max_contexts)
    return rows.groupBy("doc_id").agg(F.sum(F.col("weight") * keep).alias("background"))


def expand_general_proba(weights: DataFrame, model: CountModel, by: Sequence[str],
                         pool: str | None = None) -> DataFrame:
    """Token-level values ``(*by, token_id, value)`` of weighted contexts.

    ``weights`` holds (*by, prev, weight). Every vocabulary token gets a row in
    each group, so groups must be few, like chunks.
    """
    pool = pool or model.pools[0]
    by = list(by)
    # One row a context, with its total and the few groups that use it, meets the pairs as counted.
    packed = weights.groupBy("prev").agg(F.collect_list(F.struct(*by, "weight")).alias("_used")).join(
        model.contexts.select("prev", F.col(f"c_{pool}").alias("_c")), "prev")
    met = lookup_join(model.counts.select("prev", "token_id", f"n_{pool}"), packed, ["prev"], ["_used", "_c"], ["token_id"])
    share = F.when(F.col("_c") > 0, model.lam * F.col(f"n_{pool}") / F.col("_c")).otherwise(F.lit(0.0))
    each = met.select("token_id", share.alias("_b"), F.explode("_used").alias("_g")).select("token_id", "_b", "_g.*")
    sparse = each.groupBy(*by, "token_id").agg(F.sum(F.col("weight") * F.col("_b")).alias("value"))
    mass = lookup(weights, model.contexts, ["prev"], [f"keep_{pool}"], by, model.max_contexts).groupBy(*by).agg(
        F.sum(F.col("weight") * F.coalesce(f"keep_{pool}", F.lit(1.0))).alias("_mass"))
    # The groups are few, so they travel to the vocabulary and not the other way round.
    groups = mass.agg(F.collect_list(F.struct(*by, "_mass")).alias("all")).scalar()
    smooth = model.unigrams.select("token_id", f"u_{pool}").withColumn("_all", groups).select(
        "token_id", f"u_{pool}", F.explode("_all").alias("_g")).select(
        *[F.col(f"_g.{c}") for c in by], "token_id", (F.col("_g._mass") * F.col(f"u_{pool}")).alias("value"))
    return sparse.unionByName(smooth).groupBy(*by, "token_id").agg(F.sum("value").alias("value"))


def general_proba(doc_weights: DataFrame, model: CountModel, by: Sequence[str] = ("chunk_id",),
                  pool: str | None = None, store: bool = False) -> DataFrame:
    """Unweighted mean of the documents' distributions.

    Being linear in the weights, it averages the weights first and meets the
    model once per group, instead of once per document. Documents without a
    scored slot have no weights and do not count.
    """
    by = list(by)
    if store:
        doc_weights = materialize(doc_weights, "doc_weights")
    docs = doc_weights.select(*by, "doc_id").distinct().groupBy(*by).agg(F.count("*").alias("_docs"))
    mean = doc_weights.groupBy(*by, "prev").agg(F.sum("weight").alias("_w")).join(docs, by).select(
        *by, "prev", (F.col("_w") / F.col("_docs")).alias("weight"))
    if store:
        mean = materialize(mean, "mean_weights")
    return expand_general_proba(mean, model, by, pool)


# ----------------------------------------------------------- score intake

def from_token_scores(df: DataFrame) -> DataFrame:
    """Accept externally made scores; columns are checked and cast to the schema."""
    missing = [f.name for f in TOKEN_SCORES if f.name not in df.columns and f.name != "top"]
    if missing:
        raise ValueError(f"token scores lack {', '.join(missing)}")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in TOKEN_SCORES]
    rest = [c for c in df.columns if c not in TOKEN_SCORES.names]
    return df.select(*cols, *rest)


def score_with(corpus: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
               schema: T.StructType | str = TOKEN_SCORES) -> DataFrame:
    """Run a user's own scorer over partitions of the tokenised corpus."""
    return corpus.mapInPandas(fn, schema)
