"""Whole runs over composed documents whose members repeat what the model was trained on."""

import random

import pytest
from pyspark.sql import functions as F

from inkprobe.operators import scoring as sc
from inkprobe.plans import membership as mb
from inkprobe.plans import score_queries as sq
from inkprobe.sources import sinks


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    phrases = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(6)) for _ in range(12)]
    rows = []
    for i in range(60):
        member = i < 30
        words = " ".join(rng.choice(phrases) for _ in range(20)) if member else " ".join(
            rng.choice("abcdefghijklmnop") * 2 for _ in range(120))
        rows.append((i, words, member))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, member boolean")
    return mb.score_chunks(docs, F.col("member"), ~F.col("member"), n_chunks=3, min_len=50)


def test_members_score_lower(data):
    means = {r["label"]: r["m"] for r in data.scores.groupBy("label").agg(F.avg("nll").alias("m")).collect()}
    assert means[1] < means[0] - 0.3
    assert data.scores.select("doc_id").distinct().count() == 60
    assert data.general_proba.groupBy("chunk_id").agg(F.sum("value").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_cross_validation_tells_members_apart(data):
    metrics, predictions = mb.cross_validate(data, models="logistic_regression,random_forest", trees=10)
    rows = metrics.collect()
    assert len(rows) == 6 and all(r["test_acc"] > 0.8 and r["test_auc"] > 0.9 for r in rows)
    assert predictions.groupBy("model", "fold", "doc_id").count().filter("count <> 1").count() == 0
    points = mb.roc_points(predictions).collect()
    assert {(r["model"], r["fold"]) for r in points} == {(r["model"], r["fold"]) for r in rows}
    assert all(0 <= r["fpr"] <= 1 and 0 <= r["tpr"] <= 1 for r in points)


def test_grid_runs_every_model_of_every_experiment(data):
    specs = {"a": ("none", "token_freq", "simple_agg"), "b": ("ratio", "general_proba", "hist_10")}
    grid = mb.run_grid(data, specs, trees=5)
    keys = {(r["experiment_name"], r["model"]) for r in grid.select("experiment_name", "model").distinct().collect()}
    assert keys == {(e, m) for e in specs for m in ("logistic_regression", "random_forest")}


def test_features_are_made_where_documents_lie(data):
    """Tokens are neither stored as rows nor shuffled for features of any kind."""
    from dataclasses import replace

    by_row = replace(data, documents=None)
    for norm_type in ("none", "ratio", "diff_max_token_proba"):
        for kind in ("simple_agg", "hist_7"):
            shown = ["fold", "doc_id", "chunk_id", "label", "role", F.transform("x", lambda v: F.round(v, 7)).alias("x")]
            got, want = (sorted(map(str, mb.fold_features(d, norm_type, "token_freq", kind).select(*shown).collect()))
                         for d in (data, by_row))
            assert got == want and len(got) == 180
        hist = mb.fold_histograms(data, norm_type, "token_freq", 7)
        want = mb.fold_histograms(by_row, norm_type, "token_freq", 7)
        shown = ["fold", "doc_id", "bin", F.round("density", 7).alias("density")]
        assert sorted(map(str, hist.select(*shown).collect())) == sorted(map(str, want.select(*shown).collect()))
        plan = hist._jdf.queryExecution().executedPlan().toString()
        top = plan[:plan.index("FlatMapCoGroupsInArrow")] if norm_type != "none" else plan
        assert "Exchange" not in top


def test_scores_made_elsewhere_give_the_same_values(data):
    given = data.scores.select("doc_id", "pos", "token_id", "nll", F.create_map(F.lit(0), F.col("max_p")).alias("top"))
    chunks = data.scores.select("doc_id", "chunk_id", "label").distinct()
    other = mb.chunks_from_scores(given, chunks, data.chunk_tokens, data.token_freq, data.general_proba, data.n_chunks)
    for kind in ("ratio", "diff_max_token_proba"):
        same = [sorted(map(str, mb.fold_arrays(x, kind, "token_freq").collect())) for x in (data, other)]
        assert same[0] == same[1]
    with pytest.raises(ValueError, match="lack"):
        sc.from_token_scores(given.drop("nll"))


def test_run_is_stored_whole(spark, data, tmp_path):
    metrics = mb.run_experiment(data, "base", str(tmp_path), "logistic_regression")
    assert metrics.count() == 3
    settings = {r["key"]: r["value"] for r in sinks.read_run(spark, "run_params", str(tmp_path), "base").collect()}
    assert settings["norm_type"] == "none" and settings["seed"] == "42"
    assert sinks.read_run(spark, "predictions", str(tmp_path), "base").count() == 180
    assert sinks.read_run(spark, "roc_points", str(tmp_path), "base").count() >= 6


def test_grid_fits_every_experiment_and_fold_as_alone(data):
    """All ten experiments in one run of the grid; regression probabilities equal those of a run of its own."""
    from inkprobe import params
    from inkprobe.operators import evaluate as ev

    grid = mb.run_grid(data, trees=3)
    counts = {(r["experiment_name"], r["model"]): r["n"] for r in grid.groupBy(
        "experiment_name", "model").agg(F.count("*").alias("n")).collect()}
    assert counts == {(name, model): 180 for name in params.EXPERIMENTS for model in ev.model_list(ev.DEFAULT_MODELS)}
    for name in ("token_freq_norm_agg", "general_proba_diff_max_hist"):
        alone = mb.cross_validate(data, *params.EXPERIMENTS[name], models="logistic_regression")[1]
        key = lambda r: (r["fold"], r["doc_id"], r["role"])
        want = {key(r): r["proba"] for r in alone.collect()}
        got = {key(r): r["proba"] for r in grid.filter(
            (F.col("experiment_name") == name) & (F.col("model") == "logistic_regression")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    metrics = ev.fold_metrics(grid, ["experiment_name", "model", "fold"])
    assert metrics.count() == 10 * 2 * 3


def test_unread_losses_do_not_travel_to_the_norms(spark, data, monkeypatch):
    given, look_up = [], sq.nm.norm_lookup
    monkeypatch.setattr(sq, "chunked", lambda *_, **__: data)
    monkeypatch.setattr(sq.nm, "norm_lookup", lambda docs, *rest: given.append(docs.columns) or look_up(docs, *rest))
    assert sq.c6(spark, "").count() == 60 * 3
    assert not {"nll", "max_p"} & set(given[0])


def test_scores_read_once_are_not_stored(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b a c w{i % 3} a b", i % 2 == 0) for i in range(12)],
                                 "doc_id bigint, text string, member boolean")
    stored, store = [], mb.materialize
    monkeypatch.setattr(mb, "materialize", lambda df, name, *rest: stored.append(name) or store(df, name, *rest))
    make = lambda **options: mb.score_chunks(
        docs, F.col("member"), ~F.col("member"), n_chunks=2, min_len=2, **options)
    monkeypatch.setattr(sq, "chunked", lambda *_, **options: make(**options))
    once = sq.e2(spark, "").collect()
    assert "counts" in stored and "scores" not in stored
    assert sorted(once) == sorted(sq._value_sums(mb.fold_values(make(), "none", "token_freq")).collect())
    assert "scores" in stored
