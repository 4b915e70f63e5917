import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.operators import evaluate as ev
from inkprobe.operators import features as ft
from inkprobe.operators import normalise as nm


def test_fold_norms_and_lookup(spark):
    norm = spark.createDataFrame([(0, 7, .5), (0, 8, .5), (1, 7, .25), (1, 9, .75), (2, 7, 1.)],
                                 "chunk_id int, token_id int, value double")
    sizes = spark.createDataFrame([(0, 4), (1, 12), (2, 5)], "chunk_id int, tokens bigint")
    norms = nm.fold_norms(norm, sizes, 3).cache()
    assert {r["token_id"]: r["value"] for r in norms.filter("fold = 2").collect()} == {7: .3125, 8: .125, 9: .5625}
    scores = spark.createDataFrame([(7, 1., .5), (8, 2., .9), (99, 0., 1.)], "token_id int, nll double, max_p double")
    rows = nm.norm_lookup(scores.withColumn("fold", F.lit(2)), norms, 3)
    ratio = {r["token_id"]: r["value"] for r in nm.normalize(rows, "ratio").collect()}
    diff = {r["token_id"]: r["value"] for r in nm.normalize(rows, "diff_max_token_proba").collect()}
    wide = nm.norm_arrays(scores, norms, 3)
    for kind, want in (("ratio", ratio), ("diff_max_token_proba", diff)):
        got = {r["token_id"]: r["values"][2] for r in nm.normalize_folds(wide, kind, 3).collect()}
        assert got == pytest.approx(want)
    assert ratio == pytest.approx({7: -0.163150809806, 8: -0.079441541680, 99: -2.772588722240})
    assert diff == pytest.approx({7: -1.021448343178, 8: -0.632697497196, 99: -2.772588722240})
    with pytest.raises(ValueError):
        nm.normalize(rows, "just_norm_val")


def test_guard(spark):
    rows = spark.createDataFrame([(800., .5, .5), (1., 0., .5), (800., .5, 1.)], "nll double, norm double, max_p double")
    assert [r["value"] for r in nm.normalize(rows, "ratio").collect()][:2] == [1e-5, 1e-5]
    assert nm.normalize(rows, "diff_max_token_proba").collect()[2]["value"] == 1e-5


def test_agg_features(spark):
    rng = random.Random(1)
    docs = {1: [1., 2., 4., 8.], 2: [3.], 3: [rng.gauss(0, 9) for _ in range(57)]}
    df = spark.createDataFrame([(d, float(v)) for d, vs in docs.items() for v in vs], "doc_id int, value double")
    qs = [1, 5, 10, 25, 50, 75, 90, 95, 99]
    for r in ft.agg_features(df, ["doc_id"]).collect():
        v = docs[r["doc_id"]]
        want = [np.mean(v), np.min(v), np.max(v), np.std(v), len(v), *np.percentile(v, qs)]
        assert list(r)[1:] == pytest.approx([float(x) for x in want])
    wide = df.withColumn("values", F.array("value", F.col("value") * 2))
    got = ft.agg_features_folds(wide, ["doc_id"], 2).filter("fold = 1 AND doc_id = 1").first()
    assert got["mean"] == 7.5 and got["perc_50"] == 6.0


def hist_input(spark, docs):
    return spark.createDataFrame([(0, d, c, float(v)) for (d, c), vs in docs.items() for v in vs],
                                 "fold int, doc_id int, chunk_id int, value double")


def test_histograms(spark):
    docs = {(1, 1): [0, 1, 2], (2, 1): [2, 4], (3, 0): [-1, 4, 5, 3], (4, 0): [-3, 9]}
    rows = hist_input(spark, docs)
    edges = ft.hist_edges(rows.filter("chunk_id <> fold"), 4)
    hist = ft.hist_features(rows, edges, 4, ["fold", "doc_id"])
    dense = {r["doc_id"]: r["x"] for r in ft.dense_vectors(hist, 4, ["fold", "doc_id"]).collect()}
    assert dense[1] == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0])
    assert dense[2] == [0, 0, .5, .5] and dense[3] == [0, 0, 0, 1] and dense[4] == [None] * 4
    flat = ft.hist_edges(hist_input(spark, {(1, 1): [3, 3]}), 4).select(
        *[ft.edge(F.lit(i), 4) for i in range(5)]).first()
    assert list(flat) == [2.5, 2.75, 3, 3.25, 3.5]


def test_histogram_agrees_with_numpy(spark):
    rng = np.random.default_rng(5)
    docs = {(d, d % 2): np.round(rng.normal(0, 3, 60), 1).tolist() for d in range(8)}
    rows = hist_input(spark, docs)
    train = [v for (_, c), vs in docs.items() if c != 0 for v in vs]
    bins = np.histogram(train, bins=37)[1]
    hist = ft.hist_features(rows, ft.hist_edges(rows.filter("chunk_id <> fold"), 37), 37, ["fold", "doc_id"])
    for r in ft.dense_vectors(hist, 37, ["fold", "doc_id"]).collect():
        want = np.histogram(docs[r["doc_id"], r["doc_id"] % 2], bins, density=True)[0]
        assert r["x"] == pytest.approx(want.tolist())


def test_scaling(spark):
    df = spark.createDataFrame([(0, "train", 2., 1.), (0, "train", 4., 1.), (0, "test", 5., 7.)],
                               "fold int, role string, a double, b double")
    got = sorted((r["role"], r["a"], r["b"]) for r in ft.scale_columns(df, ["a", "b"]).collect())
    assert got == [("test", 1.5, 0.0), ("train", 0.0, 0.0), ("train", 1.0, 0.0)]


def test_extract_scaled_histogram(spark):
    rng = np.random.default_rng(2)
    docs = {d: rng.normal(d % 2, 1, 40).tolist() for d in range(10)}
    rows = spark.createDataFrame([(d, d % 2, 1, [v, v + 1]) for d, vs in docs.items() for v in vs],
                                 "doc_id int, chunk_id int, label int, values array<double>")
    got = {(r["fold"], r["doc_id"]): r["x"] for r in ft.extract_scaled(rows, "hist_9", 2).collect()}
    for fold in (0, 1):
        vals = {d: [v + fold for v in vs] for d, vs in docs.items()}
        bins = np.histogram([v for d in vals if d % 2 != fold for v in vals[d]], bins=9)[1]
        x = {d: np.histogram(v, bins, density=True)[0] for d, v in vals.items()}
        train = np.array([x[d] for d in x if d % 2 != fold])
        lo, hi = train.min(0), train.max(0)
        for d in x:
            want = np.where(hi == lo, 0, (x[d] - lo) / np.where(hi == lo, 1, hi - lo))
            assert got[fold, d] == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        ft.feature_kind("hist")


def test_auc_and_roc(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [.9, .8, .8, .1, .4])), "label int, score double")
    assert ev.auc(df, "score").first()["auc"] == 0.75
    assert ev.auc(df.withColumn("score", F.exp("score") * 3), "score").first()["auc"] == 0.75
    rows = sorted((-r["threshold"], r["fpr"], r["tpr"]) for r in ev.roc_curve(df, "score").collect())
    assert rows == [(-math.inf, 0, 0), (-.9, 0, pytest.approx(1 / 3)), (-.8, .5, pytest.approx(2 / 3)),
                    (-.4, .5, 1), (-.1, 1, 1)]
    line = spark.createDataFrame([(0, .1), (0, .2), (0, .3), (1, .4)], "label int, score double")
    assert sorted(r["threshold"] for r in ev.roc_curve(line, "score").collect()) == [.1, .4, math.inf]


def test_fit_validate(spark):
    rng = random.Random(4)
    rows = [(f, d, d % 2, d % 2, "test" if d % 4 == f else "train", [rng.random() + d % 2, rng.random()])
            for f in (0, 1) for d in range(40)]
    df = spark.createDataFrame(rows, "fold int, doc_id int, chunk_id int, label int, role string, x array<double>")
    pred = ev.fit_validate(df, "logistic_regression,random_forest,mlp", trees=5)
    assert pred.count() == 3 * len(rows)
    metrics = ev.fold_metrics(pred).collect()
    assert len(metrics) == 6 and all(r["train_auc"] > 0.9 for r in metrics)
    with pytest.raises(ValueError):
        ev.model_list("svm")


def _same_features(got, by, docs):
    for r in got.collect():
        v = np.array(docs[tuple(r[c] for c in by)])
        want = [v.mean(), v.min(), v.max(), v.std(), len(v), *np.percentile(v, [1, 5, 10, 25, 50, 75, 90, 95, 99])]
        assert [r[c] for c in ("mean", "min", "max", "std", "count", *[f"perc_{p}" for p in params.PERCENTILES])] == (
            pytest.approx(want, rel=1e-9, abs=1e-12))


def test_long_documents_have_the_same_features_without_arrays_of_all_values(spark):
    rng = np.random.default_rng(6)
    docs = {1: rng.normal(size=3_000), 2: np.repeat([1.0, 2.0, 5.0], 700),      # heavy ties
            3: np.exp(rng.normal(size=2_500) * 12), 4: rng.normal(size=20),     # many sizes; short
            5: np.append(np.full(2_000, 0.25), [5e-324, 1e-323, 9e15]), 6: np.array([3.0])}
    rows = spark.createDataFrame(
        [(d, d % 2, 1, p, [float(v), float(-v)]) for d, vs in docs.items() for p, v in enumerate(vs)],
        "doc_id int, chunk_id int, label int, pos int, values array<double>").repartition(5)
    by = ["doc_id", "chunk_id", "label"]
    both = {(d, f): vs if f == 0 else -vs for d, vs in docs.items() for f in (0, 1)}
    for table in (rows, rows.drop("pos")):
        got = ft.agg_features_folds(table, by, 2, longest=64)
        assert got.count() == 2 * len(docs)
        _same_features(got, ["doc_id", "fold"], both)
    assert sorted(map(str, ft.agg_features_folds(rows, by, 2).select("doc_id", "fold", "perc_50").collect())) == sorted(
        map(str, ft.agg_features_folds(rows, by, 2, longest=64).select("doc_id", "fold", "perc_50").collect()))


def test_a_document_of_ten_million_values(spark):
    n = 10_000_000
    rows = spark.range(n, numPartitions=8).selectExpr(
        "1 AS doc_id", "0 AS chunk_id", "1 AS label", "cast(id AS int) AS pos",
        f"array(cast((id * 7919) % {n} AS double)) AS values")  # every number below n once
    got = ft.agg_features_folds(rows, ["doc_id", "chunk_id", "label"], 1).collect()
    assert len(got) == 1 and got[0]["count"] == n and got[0]["max"] == n - 1
    for p in params.PERCENTILES:
        assert got[0][f"perc_{p}"] == pytest.approx((n - 1) * p / 100)


def test_features_of_document_arrays_equal_those_of_their_tokens(spark):
    rows = [(i % 7, 0, 1, list(range(n)), [float((k * 37) % 11) if k % 5 else None for k in range(n)], [1.5] * n)
            for i, n in enumerate([0, 1, 2, 9, 40, 3, 5, 6, 30])]
    docs = spark.createDataFrame(rows, "doc_id long, chunk_id int, label int, input_ids array<int>, v_0 array<double>, v_1 array<double>")
    by = ["doc_id", "chunk_id", "label"]
    long = docs.select(*by, F.explode(F.arrays_zip("v_0", "v_1")).alias("v")).select(*by, F.array("v.v_0", "v.v_1").alias("values"))
    columns = ["doc_id", "fold", *[F.round(c, 9).alias(c) for c in ft.params.AGG_FEATURES]]
    got = ft.agg_features_documents(docs, docs, by, 2, longest=20).select(*columns)
    want = ft.agg_features_folds(long, by, 2).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_histograms_of_document_arrays_equal_those_of_their_tokens(spark):
    rows = [(i % 7, i % 2 if i < 7 else (i - 7) % 2, 1, [float((k * 37) % 11) if k % 5 else None for k in range(n)],
             [None if i == 4 else 0.1 * k + i for k in range(n)]) for i, n in enumerate([0, 1, 2, 9, 40, 3, 5, 6, 30])]
    docs = spark.createDataFrame(rows, "doc_id long, chunk_id int, label int, v_0 array<double>, v_1 array<double>")
    by, columns = ["doc_id", "chunk_id", "label"], ["v_0", "v_1"]
    long = docs.select(*by, F.explode(F.arrays_zip(*columns)).alias("v")).select(*by, F.array("v.v_0", "v.v_1").alias("values"))
    listed = lambda df: sorted(map(str, df.collect()))
    for k in (1, 4, 9):
        edges = ft.hist_edges_documents(docs, k, columns)
        assert listed(edges) == listed(ft.hist_edges_folds(long, k, 2))
        values = long.select(*by, F.posexplode("values").alias("fold", "value"))
        want = ft.hist_features(values, edges, k, ["fold", *by], 2)
        found = ft.hist_features_documents(docs, docs, edges, k, by, columns)
        shown = ["fold", *by, "bin", F.round("density", 9).alias("density")]
        assert listed(ft.unpacked(found).select(*shown)) == listed(want.select(*shown))
        rounded = ["fold", *by, "role", F.transform("x", lambda v: F.round(v, 9)).alias("x")]
        assert listed(ft.scaled_histograms(docs, docs, k, columns).select(*rounded)) == listed(
            ft.extract_scaled(long, f"hist_{k}", 2).select(*rounded))
    alone = docs.filter("doc_id > 1")  # the others share theirs
    plan = ft.hist_features_documents(alone, alone, edges, 9, by, columns)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
