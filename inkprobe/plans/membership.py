"""Whole runs: from documents to fold features, predictions and experiment grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.operators import evaluate as ev
from inkprobe.operators import features as ft
from inkprobe.operators import normalise as nm
from inkprobe.operators import sampling as sp
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk
from inkprobe.session import materialize, run_folder, small
from inkprobe.sources import sinks


_DOC = ["doc_id", "chunk_id", "label"]


@dataclass(frozen=True)
class ChunkedScores:
    """Everything folds need: token scores of the chunks and their norm tables."""

    scores: DataFrame          # doc_id, chunk_id, label, pos, token_id, nll, max_p
    chunk_tokens: DataFrame    # chunk_id, tokens
    token_freq: DataFrame      # chunk_id, token_id, value
    make_general_proba: Callable[[], DataFrame]
    n_chunks: int
    documents: DataFrame | None = None  # the scores as arrays in blocks, where a run keeps them so
    context: int = params.CONTEXT
    stride: int = params.STRIDE

    @cached_property
    def general_proba(self) -> DataFrame:
        """(chunk_id, token_id, value), made when first asked for."""
        return self.make_general_proba()

    @cached_property
    def _fold_norms(self) -> dict[str, DataFrame]:
        return {}

    def fold_norms(self, name: str) -> DataFrame:
        """:func:`~inkprobe.operators.normalise.fold_norms` of a norm table, stored when first asked for."""
        if name not in self._fold_norms:
            self._fold_norms[name] = materialize(
                nm.fold_norms(self.norm(name), self.chunk_tokens, self.n_chunks), "norms")
        return self._fold_norms[name]

    def norm(self, name: str) -> DataFrame:
        if name not in ("token_freq", "general_proba"):
            raise ValueError(f"no such norm table: {name!r}")
        return getattr(self, name)


def score_chunks(docs: DataFrame, member: Column, non_member: Column, n_chunks: int = params.N_CHUNKS,
                 n_pos: int | None = None, min_len: int = params.MIN_TOKENS, seed: int = params.SEED,
                 context: int = params.CONTEXT, stride: int = params.STRIDE,
                 size: int | None = None, keep_tables: bool = True, keep_scores: bool = True) -> ChunkedScores:
    """Chunk, train on the member pool and score.

    ``docs`` has text and the columns the two class conditions use. With
    ``keep_tables`` the vocabulary, model, tokens and scores are written to the
    shared folder once and all later steps read them. Scores that are read once need no table (``keep_scores``).
    """
    hold = materialize if keep_tables else (lambda df, name: df)
    classed = docs.select("doc_id", "text", F.when(member, 1).when(non_member, 0).alias("_class"))
    vocab, corpus = tk.vocab_and_corpus(classed, ["_class"], size)
    # Documents with a token.
    lengths = corpus.select("doc_id", F.size("input_ids").alias("n_tokens"), "_class").filter("n_tokens > 0")
    chunks = hold(sp.split_chunks(lengths.filter("_class = 1"), lengths.filter("_class = 0"),
                                  n_chunks, n_pos, min_len, seed), "chunks").drop("row_in_chunk")
    model = sc.train(corpus, vocab, {"target": F.col("_class") == 1}, store=keep_tables)
    chosen = corpus.drop("_class").join(small(chunks, chunks.count()), "doc_id")
    chosen = hold(chosen, "chunk_tokens")
    long = tk.token_rows(chosen, ["chunk_id"])
    counts = hold(tk.token_counts(long, ["chunk_id"]), "counts")
    scored = sc.score_documents(chosen, model, max_p=True)
    scored = hold(scored, "scores") if keep_scores else scored
    weights = sc.doc_general_proba(chosen, ["chunk_id"], context, stride)
    scores = sc.scored_rows(scored, ["chunk_id", "label"], context, stride).select(
        "doc_id", "chunk_id", "label", "pos", "token_id", "nll", "max_p")
    return ChunkedScores(
        scores, counts.groupBy("chunk_id").agg(F.sum("n").alias("tokens")),
        tk.token_freq(counts, ["chunk_id"]).select("chunk_id", "token_id", "value"),
        lambda: sc.general_proba(weights, model, store=keep_tables), n_chunks, scored, context, stride)


def chunks_from_scores(scores: DataFrame, chunks: DataFrame, chunk_tokens: DataFrame, token_freq: DataFrame,
                       general_proba: DataFrame | None = None, n_chunks: int = params.N_CHUNKS) -> ChunkedScores:
    """What :func:`score_chunks` gives, from token scores made elsewhere.

    ``scores`` as :func:`~inkprobe.operators.scoring.from_token_scores` takes them, ``chunks`` with
    doc_id, chunk_id and label. The highest probability comes from ``top``. Scores of
    documents in no chunk are left out.
    """
    chunks = materialize(chunks.select("doc_id", "chunk_id", "label"), "given_chunks")
    rows = sc.from_token_scores(scores).join(small(chunks, chunks.count()), "doc_id")
    best = F.col("max_p") if "max_p" in rows.columns else F.array_max(F.map_values("top"))
    rows = rows.select("doc_id", "chunk_id", "label", "pos", "token_id", "nll", best.alias("max_p"))
    return ChunkedScores(rows, chunk_tokens.select("chunk_id", "tokens"), token_freq,
                         lambda: token_freq if general_proba is None else general_proba, n_chunks)


def with_fold_norms(data: ChunkedScores, norms: DataFrame, max_p: bool = True) -> DataFrame:
    """The scores with ``norms``, the norm of each fold as an array; ``max_p`` where it is asked for."""
    if data.documents is None:
        return nm.norm_arrays(data.scores, norms, data.n_chunks)
    # Arrays that are not read need not travel to their norms.
    known = data.documents if max_p else data.documents.drop("max_p")
    return nm.norm_arrays(known, norms, data.n_chunks, data.context, data.stride)


def fold_documents(data: ChunkedScores, norm_type: str, norm_table: str) -> DataFrame | None:
    """Documents with their normalised values of each fold as arrays; None where scores or values are no such arrays."""
    if data.documents is None or norm_type == "none":
        return None
    norms = data.fold_norms(norm_table)
    known = data.documents.drop("max_p") if norm_type == "ratio" else data.documents
    return nm.value_documents(known, norms, norm_type, data.n_chunks, data.context, data.stride)


def fold_arrays(data: ChunkedScores, norm_type: str, norm_table: str) -> DataFrame:
    """Normalised values ``(doc_id, chunk_id, label, pos, values[fold])``.

    Norms come from each fold's training chunks and are applied to all chunks.
    """
    rows = data.scores
    if norm_type != "none":
        rows = with_fold_norms(data, data.fold_norms(norm_table), norm_type != "ratio")
    return nm.normalize_folds(rows, norm_type, data.n_chunks).select(
        "doc_id", "chunk_id", "label", "pos", "values")


def fold_values(data: ChunkedScores, norm_type: str, norm_table: str) -> DataFrame:
    """:func:`fold_arrays` with one row per fold."""
    doc = ["doc_id", "chunk_id", "label"]
    docs = fold_documents(data, norm_type, norm_table)
    if docs is not None:
        folds = docs.select(*doc, "pos", F.posexplode(F.array(*[f"v_{f}" for f in range(data.n_chunks)])).alias("fold", "_v"))
        each = folds.select(*doc, "fold", F.explode(F.arrays_zip("pos", F.col("_v").alias("value"))).alias("_e"))
        return each.select(*doc, "_e.pos", "fold", "_e.value")
    rows = fold_arrays(data, norm_type, norm_table)
    return rows.select(*doc, "pos", F.posexplode("values").alias("fold", "value"))


def _value_arrays(data: ChunkedScores, norm_type: str, norm_table: str) -> tuple[DataFrame, list[str]] | None:
    """Documents with their normalised values as arrays, and the array of each fold; None where scores are no arrays."""
    if data.documents is None:
        return None
    if norm_type == "none":  # the losses, in every fold
        return nm.plain_documents(data.documents, _DOC, data.context, data.stride), ["v"] * data.n_chunks
    return fold_documents(data, norm_type, norm_table), [f"v_{f}" for f in range(data.n_chunks)]


def fold_aggregates(data: ChunkedScores, norm_type: str, norm_table: str) -> DataFrame:
    """Aggregate features ``(doc_id, chunk_id, label, fold, mean, ...)``; documents kept as arrays do not move for them."""
    found = _value_arrays(data, norm_type, norm_table)
    if found is None:
        return ft.agg_features_folds(fold_arrays(data, norm_type, norm_table), _DOC, data.n_chunks)
    values, columns = found
    if norm_type == "none":
        one = ft.agg_features_documents(values.withColumnRenamed("v", "v_0"), data.documents, _DOC, 1)
        return one.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(data.n_chunks - 1)))).select(
            *_DOC, "fold", *params.AGG_FEATURES)
    return ft.agg_features_documents(values, data.documents, _DOC, data.n_chunks)


def fold_histograms(data: ChunkedScores, norm_type: str, norm_table: str, k: int) -> DataFrame:
    """Densities of the filled bins ``(fold, doc_id, chunk_id, label, bin, density)``; documents kept as arrays do not move for them."""
    found = _value_arrays(data, norm_type, norm_table)
    by = ["fold", *_DOC]
    if found is None:
        rows = fold_arrays(data, norm_type, norm_table)
        edges = ft.hist_edges_folds(rows, k, data.n_chunks)
        local = rows.repartition("doc_id").select(*_DOC, F.posexplode("values").alias("fold", "value"))
        return ft.hist_features(local, edges, k, by, data.n_chunks)
    values, columns = found
    return ft.unpacked(ft.hist_features_documents(
        values, data.documents, ft.hist_edges_documents(values, k, columns), k, _DOC, columns))


def fold_features(data: ChunkedScores, norm_type: str, norm_table: str, kind: str) -> DataFrame:
    """Scaled features ``(fold, doc_id, chunk_id, label, role, x)``."""
    k = ft.feature_kind(kind)
    if k is None:
        return ft.scaled_aggregates(fold_aggregates(data, norm_type, norm_table), data.n_chunks)
    found = _value_arrays(data, norm_type, norm_table)
    if found is not None:
        return ft.scaled_histograms(found[0], data.documents, k, found[1])
    return ft.extract_scaled(fold_arrays(data, norm_type, norm_table), kind, data.n_chunks)


def cross_validate(data: ChunkedScores, norm_type: str = "ratio", norm_table: str = "token_freq",
                   kind: str = "simple_agg", models: str = ev.DEFAULT_MODELS, seed: int = params.SEED,
                   trees: int = ev.FOREST_TREES) -> tuple[DataFrame, DataFrame]:
    """Leave one chunk out; returns (fold metrics, predictions)."""
    rows = materialize(fold_features(data, norm_type, norm_table, kind), "fold_features", ["fold"])
    # Stored once: accuracy, AUC and ROC points all read them.
    predictions = materialize(ev.fit_validate(rows, models, ("fold",), seed, trees), "predictions")
    return ev.fold_metrics(predictions), predictions


def grid_features(data: ChunkedScores, specs: Mapping[str, tuple[str, str, str]] = params.EXPERIMENTS,
                  parallelism: int = 4) -> DataFrame:
    """Scaled features of all experiments in one stored table, with ``experiment_name``.

    Documents kept as arrays give their features where they lie. Else experiments that share a normalisation share its
    values. Some experiments are made side by side.
    """
    shared = {}
    for norm_type, norm_table, _ in specs.values():
        if data.documents is not None:
            if norm_type != "none":
                data.fold_norms(norm_table)  # made once, before the experiments run side by side
        elif (norm_type, norm_table) not in shared:
            shared[norm_type, norm_table] = materialize(
                fold_arrays(data, norm_type, norm_table), "fold_values")
    path = run_folder(data.scores.sparkSession, "grid_features")

    def write(name: str) -> None:
        norm_type, norm_table, kind = specs[name]
        if data.documents is not None:
            rows = fold_features(data, norm_type, norm_table, kind)
        else:
            rows = ft.extract_scaled(shared[norm_type, norm_table], kind, data.n_chunks)
        rows.write.partitionBy("fold").parquet(f"{path}/experiment_name={name}")

    pool = ThreadPool(max(1, min(parallelism, len(specs))))
    try:
        pool.map(write, specs)
    finally:
        pool.close()
    return data.scores.sparkSession.read.parquet(path)


def run_grid(data: ChunkedScores, specs: Mapping[str, tuple[str, str, str]] = params.EXPERIMENTS,
             models: str = ev.DEFAULT_MODELS, seed: int = params.SEED,
             trees: int = ev.FOREST_TREES) -> DataFrame:
    """Predictions of every experiment over shared scores, stored, with ``experiment_name``.

    All experiments and folds are groups of the same fits.
    """
    features = grid_features(data, specs)
    return materialize(ev.fit_validate(features, models, ("experiment_name", "fold"), seed, trees), "grid")


def roc_points(predictions: DataFrame, by: tuple[str, ...] = ("model", "fold")) -> DataFrame:
    return ev.roc_curve(predictions.filter("role = 'test'"), "proba", by=list(by))


def run_experiment(data: ChunkedScores, name: str, path: str, models: str = ev.DEFAULT_MODELS,
                   seed: int = params.SEED, trees: int = ev.FOREST_TREES) -> DataFrame:
    """Cross-validate one of the experiments and store the whole run below ``path``.

    Written are its settings, the metrics and ROC points of each fold and all
    predictions; returns the metrics.
    """
    norm_type, norm_table, kind = params.EXPERIMENTS[name]
    metrics, predictions = cross_validate(data, norm_type, norm_table, kind, models, seed, trees)
    settings = {"norm_type": norm_type, "norm_table": norm_table, "features": kind, "models": models,
                "seed": seed, "trees": trees, "n_chunks": data.n_chunks}
    spark = predictions.sparkSession
    sinks.write_run(spark, name, settings, {
        "metrics": metrics, "roc_points": roc_points(predictions), "predictions": predictions}, path)
    return sinks.read_run(spark, "metrics", path, name)
