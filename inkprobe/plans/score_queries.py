"""Registered queries: normalisation, features, evaluation, baselines, neighbours."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.operators import baselines as bl
from inkprobe.operators import evaluate as ev
from inkprobe.operators import features as ft
from inkprobe.operators import grouped_fits as gf
from inkprobe.operators import neighbours as nb
from inkprobe.operators import normalise as nm
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk
from inkprobe.plans import membership as mb
from inkprobe.plans.registry import (
    agg_sql,
    block,
    documents,
    is_member,
    is_non_member,
    prepare,
    query,
    rnd,
    rounded_sql,
    scored_docs,
)
from inkprobe.session import materialize, run_folder
from inkprobe.sources import sinks


K = params.HIST_BINS
AGG = list(params.AGG_FEATURES)
FOLD_KEYS = ["fold", "doc_id", "chunk_id", "label"]


def chunked(spark, d, **options):
    return mb.score_chunks(documents(spark, d), is_member(), is_non_member(), **options)


def values(spark, d, kind="ratio", table="token_freq"):
    return mb.fold_values(chunked(spark, d), kind, table)


def arrays(spark, d, kind="ratio", table="token_freq"):
    return mb.fold_arrays(chunked(spark, d), kind, table)


# ------------------------------------------------------------ normalisation


@query("e1_fold_norms_token_freq", """
  SELECT fold, token_id::INTEGER AS token_id, round(value, 10) AS value FROM fn_tf""", ["fn_tf"])
def e1_tf(spark, d):
    data = chunked(spark, d)
    return nm.fold_norms(data.token_freq, data.chunk_tokens, data.n_chunks).select(
        "fold", "token_id", rnd("value", digits=10))


@query("e1_fold_norms_general_proba", """
  SELECT fold, token_id::INTEGER AS token_id, round(value, 10) AS value FROM fn_gp""", ["fn_gp"])
def e1_gp(spark, d):
    data = chunked(spark, d)
    return nm.fold_norms(data.general_proba, data.chunk_tokens, data.n_chunks).select(
        "fold", "token_id", rnd("value", digits=10))


@query("c5_c6_norm_lookup", """
  SELECT fold, doc_id, count(*) AS n, round(sum(norm), 6) AS norm_sum FROM nl_tf GROUP BY fold, doc_id""",
       ["nl_tf"])
def c6(spark, d):
    data = chunked(spark, d)
    norms = nm.fold_norms(data.token_freq, data.chunk_tokens, data.n_chunks)
    # Losses are not read here, so they do not travel to the norms.
    docs = data.documents.drop("nll", "max_p")
    return nm.norm_lookup(docs, materialize(norms, "norms"), data.n_chunks).groupBy("fold", "doc_id").agg(
        F.count("*").alias("n"), rnd(F.sum("norm"), "norm_sum"))


def _value_sums(df):
    return df.groupBy("fold", "doc_id").agg(
        F.count("*").alias("n"), rnd(F.avg("value"), "mean_value"), rnd(F.max("value"), "max_value"),
        rnd(F.min("value"), "min_value"))


def _value_sql(source):
    return f"""
      SELECT fold, doc_id, count(*) AS n, round(avg(value), 6) AS mean_value,
             round(max(value), 6) AS max_value, round(min(value), 6) AS min_value
      FROM {source} GROUP BY fold, doc_id"""


block("plain_values", ["cscored", "folds"], """
  SELECT fold, doc_id, chunk_id, label, nll AS value,
         CASE WHEN chunk_id = fold THEN 'test' ELSE 'train' END AS role FROM cscored CROSS JOIN folds""")


@query("e2_none", _value_sql("plain_values"), ["plain_values"])
def e2(spark, d):
    return _value_sums(mb.fold_values(chunked(spark, d, keep_scores=False), "none", "token_freq"))


@query("e3_ratio", _value_sql("ratio_tf"), ["ratio_tf"])
def e3(spark, d):
    return _value_sums(values(spark, d))


@query("e3_ratio_general_proba", _value_sql("ratio_gp"), ["ratio_gp"])
def e3_gp(spark, d):
    return _value_sums(values(spark, d, "ratio", "general_proba"))


@query("e4_diff_max", _value_sql("diff_tf"), ["diff_tf"])
def e4(spark, d):
    return _value_sums(values(spark, d, "diff_max_token_proba"))


@query("e4_diff_max_general_proba", _value_sql("diff_gp"), ["diff_gp"])
def e4_gp(spark, d):
    return _value_sums(values(spark, d, "diff_max_token_proba", "general_proba"))


# Losses blown up by the position, so that exp(-nll) underflows and norms vanish.
@query("e5_guard", f"""
  SELECT doc_id, count(*) AS n,
         count(*) FILTER (exp(-nll * pos) = 0 OR norm <= 0) AS guarded,
         round(sum(CASE WHEN exp(-nll * pos) = 0 OR norm <= 0 THEN {params.GUARD_VALUE}
                        ELSE -ln(exp(-nll * pos) / norm) END), 4) AS value_sum
  FROM (SELECT *, CASE WHEN token_id % 10 = 3 THEN 0.0 ELSE 0.5 END AS norm FROM scored)
  GROUP BY doc_id""", ["scored"])
def e5(spark, d):
    rows = scored_docs(spark, d, ["si"]).select(
        "doc_id", (F.col("nll") * F.col("pos")).alias("nll"),
        F.when(F.col("token_id") % 10 == 3, 0.0).otherwise(0.5).alias("norm"))
    p_gone = (F.exp(-F.col("nll")) == 0) | (F.col("norm") <= 0)
    return nm.normalize(rows, "ratio").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count(F.when(p_gone, 1)).alias("guarded"),
        rnd(F.sum("value"), "value_sum", 4))


@query("e6_normalize_kinds", """
  SELECT 'none' AS kind, fold, count(*) AS n, round(avg(value), 6) AS mean_value FROM plain_values GROUP BY fold
  UNION ALL SELECT 'ratio', fold, count(*), round(avg(value), 6) FROM ratio_tf GROUP BY fold
  UNION ALL SELECT 'diff_max_token_proba', fold, count(*), round(avg(value), 6) FROM diff_tf GROUP BY fold""",
       ["plain_values", "ratio_tf", "diff_tf"])
def e6(spark, d):
    data = chunked(spark, d)
    norms = nm.fold_norms(data.token_freq, data.chunk_tokens, data.n_chunks)
    rows = mb.with_fold_norms(data, materialize(norms, "norms")).select(
        "nll", "max_p", F.posexplode("norms").alias("fold", "norm"))
    for kind in nm.KINDS:
        rows = nm.normalize(rows, kind).withColumnRenamed("value", kind)
    means = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.avg(k).alias(k) for k in nm.KINDS])
    return means.unpivot(["fold", "n"], list(nm.KINDS), "kind", "mean_value").select(
        "kind", "fold", "n", rnd("mean_value"))


# ----------------------------------------------------------------- features

block("f_agg", ["ratio_tf"], agg_sql("ratio_tf", "fold, doc_id, chunk_id, label, role"))


@query("f1_agg_features", f"""
  SELECT fold, doc_id, chunk_id, label, {rounded_sql(AGG)} FROM f_agg""", ["f_agg"])
def f1(spark, d):
    rows = mb.fold_aggregates(chunked(spark, d), "ratio", "token_freq")
    return rows.select(*FOLD_KEYS, *[rnd(c) for c in AGG])


block("f_edges", ["ratio_tf"], """
  SELECT fold, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
  FROM ratio_tf WHERE role = 'train' GROUP BY fold""")


def edge_sql(i):
    return f"CASE WHEN {i} = {K} THEN hi ELSE lo + ({i}) * ((hi - lo) / {K}) END"


# The scores go through the intake, as those of any other model would.
@query("f1_given_scores", f"""
  SELECT fold, doc_id, chunk_id, label, {rounded_sql(AGG)} FROM f_agg""", ["f_agg"])
def f1_given(spark, d):
    own = chunked(spark, d)
    given = own.scores.select("doc_id", "pos", "token_id", "nll", F.create_map(
        F.lit(0), F.col("max_p")).alias("top"))
    chunks = own.scores.select("doc_id", "chunk_id", "label").distinct()
    data = mb.chunks_from_scores(given, chunks, own.chunk_tokens, own.token_freq, n_chunks=own.n_chunks)
    rows = ft.agg_features_folds(mb.fold_arrays(data, "ratio", "token_freq"), FOLD_KEYS[1:], params.N_CHUNKS)
    return rows.select(*FOLD_KEYS, *[rnd(c) for c in AGG])


@query("f2_hist_edges", f"""
  SELECT fold, i::INTEGER AS i, round({edge_sql('i')}, 6) AS edge
  FROM f_edges, (SELECT unnest(range({K + 1})) AS i)""", ["f_edges"])
def f2(spark, d):
    edges = ft.hist_edges_folds(arrays(spark, d), K, params.N_CHUNKS)
    every = edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(K))))
    return every.select("fold", "i", rnd(ft.edge(F.col("i"), K), "edge"))


block("f_bins", ["ratio_tf", "f_edges"], f"""
  SELECT fold, doc_id, chunk_id, label, role, lo, hi,
         CASE WHEN value < {edge_sql('g')} THEN g - 1
              WHEN g < {K} - 1 AND value >= {edge_sql('g + 1')} THEN g + 1 ELSE g END AS bin
  FROM (SELECT *, CASE WHEN value BETWEEN lo AND hi THEN
               least(greatest(floor((value - lo) / ((hi - lo) / {K}))::INTEGER, 0), {K} - 1) END AS g
        FROM ratio_tf JOIN f_edges USING (fold))""")
block("f_hist", ["f_bins"], f"""
  SELECT fold, doc_id, chunk_id, label, role, bin,
         count(*) / (sum(count(*)) OVER (PARTITION BY fold, doc_id)
           * (({edge_sql('bin + 1')}) - ({edge_sql('bin')}))) AS density
  FROM f_bins WHERE bin IS NOT NULL GROUP BY fold, doc_id, chunk_id, label, role, bin, lo, hi""")


@query("f3_hist_features", """
  SELECT fold, doc_id, bin, round(density, 6) AS density FROM f_hist""", ["f_hist"])
def f3(spark, d):
    return mb.fold_histograms(chunked(spark, d), "ratio", "token_freq", K).select("fold", "doc_id", "bin", rnd("density"))


block("f_scaled", ["f_agg"], "SELECT fold, doc_id, chunk_id, label, role, " + ", ".join(
    f"""CASE WHEN max("{c}") FILTER (role = 'train') OVER w = min("{c}") FILTER (role = 'train') OVER w THEN 0.0
        ELSE ("{c}" - min("{c}") FILTER (role = 'train') OVER w)
             / (max("{c}") FILTER (role = 'train') OVER w - min("{c}") FILTER (role = 'train') OVER w)
        END AS "{c}" """ for c in AGG) + " FROM f_agg WINDOW w AS (PARTITION BY fold)")


@query("f5_scale_features", f"""
  SELECT fold, doc_id, role, {rounded_sql(AGG)} FROM f_scaled""", ["f_scaled"])
def f5(spark, d):
    rows = mb.fold_aggregates(chunked(spark, d), "ratio", "token_freq")
    rows = materialize(rows, "features").withColumn("role", ft.role())
    return ft.scale_columns(rows, AGG).select("fold", "doc_id", "role", *[rnd(c) for c in AGG])


@query("f4_extract_features", f"""
  SELECT 'simple_agg' AS kind, fold, doc_id, role, {len(AGG)} AS width,
         round({' + '.join(f'"{c}"' for c in AGG)}, 5) AS total FROM f_scaled
  UNION ALL
  SELECT 'hist_{K}', fold, doc_id, any_value(role), {K}, round(sum(scaled), 5) FROM (
    SELECT fold, doc_id, role, CASE WHEN lo = hi THEN 0 ELSE (density - lo) / (hi - lo) END AS scaled FROM (
      SELECT dn.*, min(density) FILTER (role = 'train') OVER w AS lo, max(density) FILTER (role = 'train') OVER w AS hi
      FROM (SELECT a.fold, a.doc_id, a.role, b.bin, coalesce(h.density, 0.0) AS density
            FROM f_agg a CROSS JOIN (SELECT unnest(range({K})) AS bin) b
            LEFT JOIN f_hist h ON h.fold = a.fold AND h.doc_id = a.doc_id AND h.bin = b.bin) dn
      WINDOW w AS (PARTITION BY fold, bin)))
  GROUP BY fold, doc_id""", ["f_scaled", "f_hist", "f_agg"])
def f4(spark, d):
    data = chunked(spark, d)
    out = None
    for kind in ("simple_agg", f"hist_{K}"):
        x = mb.fold_features(data, "ratio", "token_freq", kind)
        total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
        one = x.select(F.lit(kind).alias("kind"), "fold", "doc_id", "role", F.size("x").alias("width"),
                       rnd(total, "total", 5))
        out = one if out is None else out.unionByName(one)
    return out


# --------------------------------------------------------------- evaluation
# A plain score, minus the mean loss, evaluated over all labelled documents.
# Rounded before ties are formed: copies of a text must tie in every engine.

block("plain", ["scored"], """
  SELECT doc_id, lang, CASE WHEN si < 8 THEN 1 ELSE 0 END AS label, round(-avg(nll), 9) AS score
  FROM scored WHERE si < 16 GROUP BY doc_id, lang, si""")


def plain_scores(spark, d):
    rows = scored_docs(spark, d).filter(F.col("si") < 16)
    return rows.groupBy("doc_id", "lang", "si").agg(F.round(-F.avg("nll"), 9).alias("score")).select(
        "doc_id", "lang", is_member().cast("int").alias("label"), "score")


@query("g5_accuracy", """
  SELECT lang, round(avg(CASE WHEN (score > -7.0)::INTEGER = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
  FROM plain GROUP BY lang""", ["plain"])
def g5(spark, d):
    rows = plain_scores(spark, d).withColumn("prediction", (F.col("score") > -7.0).cast("int"))
    return ev.accuracy(rows, ["lang"]).select("lang", rnd("accuracy"))


def auc_sql(by, cols):
    return f"""
      SELECT {cols} round((sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc FROM (
        SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score)
                  + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2 AS r,
               sum(label) OVER (PARTITION BY {by}) AS p, count(*) OVER (PARTITION BY {by}) AS n FROM plain)
      GROUP BY {by if cols else '1=1'}, p, n"""


@query("g6_auc", auc_sql("1", ""), ["plain"])
def g6(spark, d):
    return ev.auc(plain_scores(spark, d), "score").select(rnd("auc", digits=9))


@query("g6_auc_by_group", auc_sql("lang", "lang,"), ["plain"])
def g6_by(spark, d):
    return ev.auc(plain_scores(spark, d), "score", by=["lang"]).select("lang", rnd("auc", digits=9))


@query("g7_roc_curve", """
  SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
  UNION ALL
  SELECT threshold, round(cn / sum_n, 9), round(cp / sum_p, 9) FROM (
    SELECT score AS threshold, p, n, sum(p) OVER up AS cp, sum(n) OVER up AS cn,
           sum(p) OVER () AS sum_p, sum(n) OVER () AS sum_n,
           lead(p) OVER o AS next_p, lead(n) OVER o AS next_n, lag(p) OVER o AS last_p
    FROM (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM plain GROUP BY score)
    WINDOW o AS (ORDER BY score DESC),
           up AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE last_p IS NULL OR next_p IS NULL OR next_p <> p OR next_n <> n""", ["plain"])
def g7(spark, d):
    shown = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return ev.roc_curve(plain_scores(spark, d), "score").select(
        shown.alias("threshold"), rnd("fpr", digits=9), rnd("tpr", digits=9))


def _predictions(spark, d, models, **kw):
    _, rows = mb.cross_validate(chunked(spark, d), models=models, **kw)
    return rows


@query("g1_logistic_regression")
def g1(spark, d):
    return _predictions(spark, d, "logistic_regression")


@query("g2_random_forest")
def g2(spark, d):
    return _predictions(spark, d, "random_forest")


@query("g3_mlp")
def g3(spark, d):
    return _predictions(spark, d, "mlp")


@query("g4_fit_validate_models")
def g4(spark, d):
    return ev.fold_metrics(_predictions(spark, d, ev.DEFAULT_MODELS, norm_table="general_proba"))


# What SQL can say of fitted models: every row is predicted once by each, as a
# probability on the right side of the prediction. It doesn't say how good they are.
@query("g8_prediction_keys", """
  SELECT model, fold, doc_id, label, role, true AS valid
  FROM f_agg, (SELECT unnest(['logistic_regression', 'random_forest']) AS model)""", ["f_agg"])
def g8_keys(spark, d):
    rows = _predictions(spark, d, ev.DEFAULT_MODELS)
    sided = (F.col("proba") > 0.5) == (F.col("prediction") == 1)
    return rows.select("model", "fold", "doc_id", "label", "role", (
        F.col("proba").between(0, 1) & (sided | (F.col("proba") == 0.5))).alias("valid"))


# A fitted intercept makes the training residuals of each fold add up to nothing.
@query("g1_residuals", """
  SELECT fold, count(*) AS n, true AS balanced FROM f_agg WHERE role = 'train' GROUP BY fold""", ["f_agg"])
def g1_residuals(spark, d):
    rows = _predictions(spark, d, "logistic_regression").filter("role = 'train'")
    return rows.groupBy("fold").agg(
        F.count("*").alias("n"), (F.abs(F.avg(F.col("proba") - F.col("label"))) < 1e-3).alias("balanced"))


# The loss of a penalised regression has one lowest point: where its slope in every
# weight is nothing. The weights follow from the stored scores, so each slope is
# worked out anew from features and probabilities alone.
@query("g1_gradient", """
  SELECT fold, feature, true AS flat FROM (SELECT DISTINCT fold FROM f_agg),
         (SELECT unnest(range(%d))::INTEGER AS feature)""" % (len(AGG) + 1), ["f_agg"])
def g1_gradient(spark, d):
    rows = materialize(mb.fold_features(chunked(spark, d), "ratio", "token_freq", "simple_agg"), "features", ["fold"])
    groups = gf.groups_of(rows, ["fold"])
    weights = gf.fit_logistic(groups)
    held = spark.createDataFrame(
        [(*groups.keys[g], i, float(w)) for g, ws in weights.items() for i, w in enumerate(ws)],
        "fold int, feature int, w double")
    scored = gf.predict(groups, weights, "logistic_regression", ["doc_id", "label", "role"])
    one = F.transform(F.concat("x", F.array(F.lit(1.0))), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    slopes = scored.filter("role = 'train'").join(rows.select("fold", "doc_id", "x"), ["fold", "doc_id"]).select(
        "fold", F.posexplode(one).alias("feature", "v"), (F.col("proba") - F.col("label")).alias("rest")).groupBy(
        "fold", "feature").agg(F.sum(F.col("v") * F.col("rest")).alias("slope"))
    penalty = F.when(F.col("feature") < len(AGG), F.col("w") / ev.LR_STRENGTH).otherwise(F.lit(0.0))
    return slopes.join(F.broadcast(held), ["fold", "feature"]).select(
        "fold", "feature", (F.abs(F.col("slope") + penalty) < 1e-6).alias("flat"))


# Metrics of a stored run against the same figures from its stored predictions.
@query("a6_write_experiment", """
  SELECT 'token_freq_norm_agg' AS experiment_name, 'logistic_regression' AS model, fold,
         count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
         true AS same_accuracy, true AS has_roc, '42' AS seed
  FROM f_agg GROUP BY fold""", ["f_agg"])
def a6_experiment(spark, d):
    path, name = run_folder(spark, "runs"), "token_freq_norm_agg"
    mb.run_experiment(chunked(spark, d), name, path, "logistic_regression")
    stored = lambda table: sinks.read_run(spark, table, path, name)
    side = lambda r: F.col("role") == r
    hit = (F.col("proba") > 0.5).cast("int") == F.col("label")
    again = stored("predictions").groupBy("experiment_name", "model", "fold").agg(
        F.count(F.when(side("train"), 1)).alias("n_train"), F.count(F.when(side("test"), 1)).alias("n_test"),
        F.avg(F.when(side("test"), hit.cast("double"))).alias("again"))
    ends = stored("roc_points").groupBy("model", "fold").agg(
        ((F.max("fpr") == 1) & (F.max("tpr") == 1) & (F.min("fpr") == 0)).alias("has_roc"))
    seed = stored("run_params").filter("key = 'seed'").select("value").scalar()
    return again.join(stored("metrics").select("model", "fold", "test_acc"), ["model", "fold"]).join(
        ends, ["model", "fold"]).select(
        "experiment_name", "model", "fold", "n_train", "n_test",
        (F.abs(F.col("again") - F.col("test_acc")) < 1e-9).alias("same_accuracy"), "has_roc", seed.alias("seed"))


@query("g8_predictions")
def g8(spark, d):
    rows = _predictions(spark, d, "logistic_regression", kind=f"hist_{params.GRID_BINS}")
    return rows.select("model", "fold", "doc_id", "label", "role", "proba")


@query("g9_fold_features", f"""
  SELECT fold, doc_id, chunk_id, label, role, round({' + '.join(f'"{c}"' for c in AGG)}, 5) AS feature_sum
  FROM f_scaled""", ["f_scaled"])
def g9_features(spark, d):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    rows = mb.fold_features(chunked(spark, d), "ratio", "token_freq", "simple_agg")
    return rows.select(*FOLD_KEYS, "role", rnd(total, "feature_sum", 5))


@query("g9_cross_validation")
def g9(spark, d):
    metrics, _ = mb.cross_validate(chunked(spark, d), models=ev.DEFAULT_MODELS)
    return metrics


# The curves of all folds, and what holds of any curve: it starts at no and ends at all
# rows, never falls, and the area below it is the fold's AUC.
@query("g9_roc_points", """
  SELECT model, fold, true AS whole, true AS rising, true AS same_area
  FROM (SELECT DISTINCT fold FROM f_agg), (SELECT unnest(['logistic_regression', 'random_forest']) AS model)""",
       ["f_agg"])
def g9_roc(spark, d):
    metrics, predictions = mb.cross_validate(chunked(spark, d), models=ev.DEFAULT_MODELS)
    points = materialize(mb.roc_points(predictions), "roc_points")
    # Points of a curve are few: collinear ones were left out.
    line = W.partitionBy("model", "fold").orderBy(F.desc("threshold"))
    steps = points.select("model", "fold", "fpr", "tpr", (F.col("fpr") - F.lag("fpr").over(line)).alias("right"),
                          (F.col("tpr") - F.lag("tpr").over(line)).alias("up"))
    area = F.sum(F.col("right") * (F.col("tpr") - F.col("up") / 2))
    per = steps.groupBy("model", "fold").agg(
        ((F.min("fpr") == 0) & (F.min("tpr") == 0) & (F.max("fpr") == 1) & (F.max("tpr") == 1)).alias("whole"),
        ((F.min("right") >= 0) & (F.min("up") >= 0)).alias("rising"), area.alias("area"))
    return per.join(metrics, ["model", "fold"]).select(
        "model", "fold", "whole", "rising", (F.abs(F.col("area") - F.col("test_auc")) < 1e-9).alias("same_area"))


# Every experiment, model and fold predicts each chunked document once, on the right
# side of a probability, and the metrics are those of the stored predictions.
_GRID = ", ".join(f"('{name}')" for name in params.EXPERIMENTS)


@query("g10_experiment_grid", f"""
  SELECT experiment_name, model, fold, count(*) FILTER (chunk_id <> fold) AS n_train,
         count(*) FILTER (chunk_id = fold) AS n_test, true AS valid, true AS same_metrics
  FROM chunks, folds, (SELECT unnest(['logistic_regression', 'random_forest']) AS model),
       (VALUES {_GRID}) e(experiment_name)
  GROUP BY experiment_name, model, fold""", ["chunks", "folds"])
def g10(spark, d):
    by = ["experiment_name", "model", "fold"]
    rows = mb.run_grid(chunked(spark, d))
    metrics = ev.fold_metrics(rows, by)
    side = lambda r: F.col("role") == r
    hit = ((F.col("proba") > 0.5).cast("int") == F.col("label")).cast("double")
    sided = (F.col("proba") > 0.5) == (F.col("prediction") == 1)
    again = rows.groupBy(*by).agg(
        F.count(F.when(side("train"), 1)).alias("n_train"), F.count(F.when(side("test"), 1)).alias("n_test"),
        F.bool_and(F.col("proba").between(0, 1) & (sided | (F.col("proba") == 0.5))).alias("valid"),
        F.avg(F.when(side("train"), hit)).alias("train"), F.avg(F.when(side("test"), hit)).alias("test"))
    # A tie at one half goes either way in a forest.
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.05
    inside = lambda c: F.col(c).between(0, 1)
    return again.join(metrics, by).select(
        *by, "n_train", "n_test", "valid", (near("train", "train_acc") & near("test", "test_acc")
                                            & inside("train_auc") & inside("test_auc")).alias("same_metrics"))


# Two experiments of the grid with their metrics.
@query("g10_default_models")
def g10_default(spark, d):
    specs = {name: params.EXPERIMENTS[name] for name in ("base", "token_freq_norm_agg")}
    return ev.fold_metrics(mb.run_grid(chunked(spark, d), specs),
                           ["experiment_name", "model", "fold"])


# ---------------------------------------------------------------- baselines

block("low", ["t", "vocab"], f"""
  SELECT t.*, coalesce(v.token_id, {params.UNK}) AS low_id FROM t LEFT JOIN vocab v ON lower(t.word) = v.token""")
block("low2", ["low"], f"""
  SELECT *, coalesce(lag(low_id) OVER (PARTITION BY doc_id ORDER BY pos), {params.BOS}) AS low_prev FROM low""")


def _nll_sql(prefix, prev, token):
    return f"""
      SELECT s.doc_id, s.pos, -ln(coalesce(b, 0) + coalesce(keep, 1.0) * u) AS v
      FROM low2 s LEFT JOIN {prefix}terms x ON x.prev = s.{prev} AND x.token_id = s.{token}
      LEFT JOIN {prefix}ctx c ON c.prev = s.{prev} JOIN {prefix}uni u ON u.token_id = s.{token}"""


block("nll_t", ["low2", "m_terms", "m_ctx", "m_uni"], _nll_sql("m_", "prev", "token_id"))
block("nll_r", ["low2", "r_terms", "r_ctx", "r_uni"], _nll_sql("r_", "prev", "token_id"))
block("nll_l", ["low2", "m_terms", "m_ctx", "m_uni"], _nll_sql("m_", "low_prev", "low_id"))
S, C = params.STRIDE, params.CONTEXT
block("wrows", ["low2", "nll_t", "nll_r", "nll_l"], f"""
  SELECT w.doc_id, w.begin, w.pos, w.n_tokens, w.token_id, w.word, w.prev, w.next, a.v AS nll,
         CASE WHEN w.pos > w.begin THEN a.v END AS s, CASE WHEN w.pos > w.begin THEN b.v END AS s_ref,
         CASE WHEN w.pos > w.begin THEN c.v END AS s_low
  FROM (SELECT *, (pos // {S}) * {S} AS begin FROM low2
        UNION ALL SELECT *, (pos // {S} - 1) * {S} FROM low2 WHERE pos % {S} < {C} - {S} AND pos >= {S}) w
  JOIN nll_t a USING (doc_id, pos) JOIN nll_r b USING (doc_id, pos) JOIN nll_l c USING (doc_id, pos)""")
block("wloss", ["wrows"], """
  SELECT doc_id, begin, count(s) AS n, avg(s) AS loss, avg(s_ref) AS loss_ref, avg(s_low) AS loss_lower,
         string_agg(token_id, ' ' ORDER BY pos) AS sequence
  FROM wrows GROUP BY doc_id, begin""")
_MINK = ", ".join(
    f"round(avg(s) FILTER (r <= floor(n * CAST({x} AS DOUBLE))), 6) AS {bl.min_k_name(x)}"
    for x in params.MIN_K_RATIOS)
block("wmin", ["wrows"], f"""
  SELECT doc_id, begin, {_MINK} FROM (
    SELECT doc_id, begin, s, row_number() OVER (PARTITION BY doc_id, begin ORDER BY s DESC NULLS LAST) AS r,
           count(s) OVER (PARTITION BY doc_id, begin) AS n FROM wrows)
  GROUP BY doc_id, begin""")


def losses(spark, d, with_word=False):
    ready = prepare(spark, d, with_ref=True, with_word=with_word, lower=True)
    return bl.window_losses(ready.corpus, ready.model)


@query("h1_window_perplexity", """
  SELECT doc_id, begin::INTEGER AS begin, n, round(loss, 6) AS loss, round(exp(loss), 4) AS ppl FROM wloss""",
       ["wloss"])
def h1(spark, d):
    return losses(spark, d).select("doc_id", "begin", "n", rnd("loss"), rnd(F.exp("loss"), "ppl", 4))


@query("h2_reference_calibration", """
  SELECT 'doc_' || doc_id AS doc_id, begin::INTEGER AS begin, round(loss - loss_ref, 6) AS ref_diff FROM wloss""",
       ["wloss"])
def h2(spark, d):
    return bl.score_table(losses(spark, d), with_zlib=False).select("doc_id", "begin", rnd("ref_diff"))


@query("h3_lowercase_ratio", """
  SELECT 'doc_' || doc_id AS doc_id, begin::INTEGER AS begin,
         round(-(loss_lower / nullif(loss, 0)), 6) AS lower_ratio FROM wloss""", ["wloss"])
def h3(spark, d):
    return bl.score_table(losses(spark, d), with_zlib=False).select("doc_id", "begin", rnd("lower_ratio"))


@query("h4_compression_ratio")
def h4(spark, d):
    return bl.score_table(losses(spark, d, with_word=True)).select("doc_id", "begin", "ppl", "zlib_ratio")


MINK_NAMES = [bl.min_k_name(r) for r in params.MIN_K_RATIOS]


@query("h5_min_k", f"""
  SELECT 'doc_' || doc_id AS doc_id, begin::INTEGER AS begin, {', '.join(MINK_NAMES)} FROM wmin""", ["wmin"])
def h5(spark, d):
    return bl.score_table(losses(spark, d), with_zlib=False).select(
        "doc_id", "begin", *[rnd(c) for c in MINK_NAMES])


_REPORT = {k: v for k, v in params.REPORT_NAMES.items() if k != "zlib_ratio"}


@query("h6_score_table", f"""
  SELECT 'doc_' || doc_id AS doc_id, sequence, round(exp(loss), 4) AS "ppl",
         round(loss - loss_ref, 6) AS "{_REPORT['ref_diff']}",
         round(-(loss_lower / nullif(loss, 0)), 6) AS "{_REPORT['lower_ratio']}",
         {', '.join(f'{c} AS "{_REPORT[c]}"' for c in MINK_NAMES)}
  FROM wloss JOIN wmin USING (doc_id, begin)""", ["wloss", "wmin"])
def h6(spark, d):
    rows = bl.score_table(losses(spark, d), with_zlib=False)
    return bl.report(rows.select(
        "doc_id", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("sequence"),
        rnd("ppl", digits=4), rnd("ref_diff"), rnd("lower_ratio"), *[rnd(c) for c in MINK_NAMES]))


# --------------------------------------------------------------- neighbours

LAM, KEEP = params.LAMBDA, 1 - params.LAMBDA
block("g_pairs", ["t"], """
  SELECT prev, next, token_id, count(*) AS n FROM t WHERE si < 8 GROUP BY prev, next, token_id""")
block("g_ctx", ["g_pairs"], "SELECT prev, next, sum(n) AS c FROM g_pairs GROUP BY prev, next")
block("g_terms", ["g_pairs", "g_ctx"], f"""
  SELECT prev, next, token_id, {LAM} * CAST(n AS DOUBLE) / c AS b FROM g_pairs JOIN g_ctx USING (prev, next)""")
block("n_pos", ["wrows"], f"""
  SELECT doc_id, begin, pos, prev, token_id, nll,
         lead(nll) OVER (PARTITION BY doc_id, begin ORDER BY pos) AS nll_next,
         CASE WHEN pos = least(begin + {C}, n_tokens) - 1 THEN {params.EOS} ELSE next END AS next, begin AS b0
  FROM wrows""")
block("n_trip", ["n_pos"], "SELECT DISTINCT prev, token_id, next FROM n_pos WHERE pos > begin")
block("n_options", ["g_terms", "g_ctx", "m_uni", "best_u", "n_trip"], f"""
  SELECT * FROM (
    SELECT prev, next, cand, p, row_number() OVER (PARTITION BY prev, next ORDER BY p DESC, cand) AS r FROM (
      SELECT prev, next, token_id AS cand, max(b) + CASE WHEN bool_or(known) THEN {KEEP} ELSE 1.0 END * any_value(u) AS p
      FROM (SELECT prev, next, token_id, b, true AS known FROM g_terms
            UNION ALL
            SELECT prev, next, token_id, 0, g.c IS NOT NULL FROM
              (SELECT prev, next FROM n_trip UNION SELECT prev, next FROM g_ctx)
              LEFT JOIN g_ctx g USING (prev, next), best_u)
      JOIN m_uni USING (token_id) GROUP BY prev, next, token_id))
  WHERE r <= {params.TOP_K}""")
block("n_cand", ["n_trip", "n_options", "g_terms", "g_ctx", "m_uni"], f"""
  SELECT t.prev, t.token_id, t.next, o.cand, o.p,
         o.p / CASE WHEN t.po = 1 THEN {params.CERTAIN_WEIGHT} ELSE 1 - t.po END AS weight
  FROM (SELECT x.*, coalesce(b, 0) + CASE WHEN g.c IS NULL THEN 1.0 ELSE {KEEP} END * u AS po
        FROM n_trip x LEFT JOIN g_terms USING (prev, token_id, next)
        LEFT JOIN g_ctx g USING (prev, next) JOIN m_uni USING (token_id)) t
  JOIN n_options o ON o.prev = t.prev AND o.next = t.next AND o.cand <> t.token_id""")
block("n_top", ["n_pos", "n_cand"], f"""
  SELECT * FROM (
    SELECT a.doc_id, a.begin, a.pos, a.prev, a.next, a.nll, a.nll_next, c.cand, c.weight,
           row_number() OVER (PARTITION BY a.doc_id, a.begin ORDER BY c.weight DESC, a.pos, c.p DESC, c.cand) AS rank
    FROM n_pos a JOIN n_cand c ON c.prev = a.prev AND c.token_id = a.token_id AND c.next = a.next
    WHERE a.pos > a.begin)
  WHERE rank <= {params.N_NEIGHBOURS}""")


def swaps(spark, d):
    """Candidates of every position, the tokens and the model they are scored with."""
    ready = prepare(spark, d, with_next=True)
    masked = sc.train(ready.tokens, ready.vocab, {"target": is_member()},
                      ctx=("prev", "next"), store=True)
    positions = materialize(nb.swap_positions(ready.tokens), "positions")  # read twice
    triples = materialize(nb.triple_options(positions, masked, ready.model), "triples")
    return nb.candidates(positions, triples), ready


# How many positions have a context that training never saw.
@query("i1_context_shares", """
  SELECT g.c IS NOT NULL AS seen, count(*) AS contexts, sum(n)::BIGINT AS positions
  FROM (SELECT prev, next, count(*) AS n FROM n_pos WHERE pos > begin GROUP BY prev, next)
  LEFT JOIN g_ctx g USING (prev, next) GROUP BY 1""", ["n_pos", "g_ctx"])
def i1_shares(spark, d):
    ready = prepare(spark, d)
    masked = sc.train(ready.corpus, ready.vocab, {"target": is_member()}, ctx=("prev", "next"), store=True)
    return nb.context_shares(nb.swap_contexts(ready.corpus), masked)


# Candidates between two tokens that were never seen around one: the tokens of highest
# p(t | prev) p(next | t). The SQL multiplies out every token of either list.
block("n_unseen", ["n_trip", "g_ctx"], """
  SELECT DISTINCT prev, next FROM n_trip ANTI JOIN g_ctx USING (prev, next) WHERE next <> %d""" % params.EOS)
block("n_common", ["m_uni", "m_ctx"], f"""
  SELECT token_id FROM m_uni LEFT JOIN (SELECT prev AS token_id, keep FROM m_ctx) USING (token_id)
  ORDER BY u * coalesce(keep, 1.0) DESC, token_id LIMIT {params.TOP_K}""")
block("n_bridge", ["n_unseen", "n_common", "m_terms", "m_ctx", "m_uni"], f"""
  SELECT prev, next, t, p FROM (
    SELECT prev, next, t, p, row_number() OVER (PARTITION BY prev, next ORDER BY p DESC, t) AS r FROM (
      SELECT e.prev, e.next, e.t,
             (coalesce(a.b, 0) + coalesce(cp.keep, 1.0) * ut.u) * (coalesce(z.b, 0) + coalesce(ct.keep, 1.0) * un.u) AS p
      FROM (SELECT prev, next, token_id AS t FROM n_unseen JOIN m_terms USING (prev)
            UNION SELECT n.prev, n.next, m.prev FROM n_unseen n JOIN m_terms m ON m.token_id = n.next
            UNION SELECT prev, next, token_id FROM n_unseen, n_common) e
      LEFT JOIN m_terms a ON a.prev = e.prev AND a.token_id = e.t
      LEFT JOIN m_terms z ON z.prev = e.t AND z.token_id = e.next
      LEFT JOIN m_ctx cp ON cp.prev = e.prev LEFT JOIN m_ctx ct ON ct.prev = e.t
      JOIN m_uni ut ON ut.token_id = e.t JOIN m_uni un ON un.token_id = e.next))
  WHERE r <= {params.TOP_K}""")


@query("i1_bridge_candidates", """
  SELECT prev::INTEGER AS prev, next::INTEGER AS next, count(*) AS n, sum(t)::BIGINT AS id_sum,
         round(max(p), 12) AS best FROM n_bridge GROUP BY prev, next""", ["n_bridge"])
def i1_bridge(spark, d):
    ready = prepare(spark, d, with_next=True)
    masked = sc.train(ready.tokens, ready.vocab, {"target": is_member()}, ctx=("prev", "next"), store=True)
    asked = nb.swap_positions(ready.tokens).filter(F.col("next") != params.EOS).select("prev", "next").distinct()
    unseen = materialize(asked.join(masked.contexts, ["prev", "next"], "left_anti"), "unseen_contexts")
    lists = nb.bridge_lists(unseen, ready.model)
    return lists.select("prev", "next", F.size("top").cast("bigint").alias("n"),
                        F.aggregate("top", F.lit(0).cast("bigint"), lambda s, t: s + t["token_id"]).alias("id_sum"),
                        F.round(F.element_at("top", 1)["p"], 12).alias("best"))


def all_windows(spark, d):
    return tk.sequence_windows(tk.doc_lengths(documents(spark, d))).select("doc_id", "begin")


@query("i1_candidates", """
  SELECT doc_id, begin::INTEGER AS begin, count(cand) AS n, sum(cand)::BIGINT AS id_sum, round(sum(p), 6) AS p_sum
  FROM win LEFT JOIN (SELECT doc_id, begin, cand, p FROM n_pos JOIN n_cand USING (prev, token_id, next)
                      WHERE pos > begin) USING (doc_id, begin) GROUP BY doc_id, begin""",
       ["win", "n_pos", "n_cand"])
def i1(spark, d):
    cands, ready = swaps(spark, d)
    each = all_windows(spark, d).join(
        cands.select("doc_id", "begin", F.explode("options").alias("o")), ["doc_id", "begin"], "left")
    return each.groupBy("doc_id", "begin").agg(
        F.count("o").alias("n"), F.sum(F.col("o.token_id").cast("bigint")).alias("id_sum"),
        rnd(F.sum("o.p"), "p_sum"))


@query("i2_candidate_weights", """
  SELECT doc_id, begin::INTEGER AS begin, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max
  FROM win LEFT JOIN (SELECT doc_id, begin, weight FROM n_pos JOIN n_cand USING (prev, token_id, next)
                      WHERE pos > begin) USING (doc_id, begin) GROUP BY doc_id, begin""",
       ["win", "n_pos", "n_cand"])
def i2(spark, d):
    cands, ready = swaps(spark, d)
    each = all_windows(spark, d).join(
        cands.select("doc_id", "begin", F.explode("options").alias("o")), ["doc_id", "begin"], "left")
    return each.groupBy("doc_id", "begin").agg(
        rnd(F.sum("o.weight"), "weight_sum"), rnd(F.max("o.weight"), "weight_max"))


@query("i3_top_neighbors", """
  SELECT doc_id, begin::INTEGER AS begin, rank::INTEGER AS rank, pos::INTEGER AS pos,
         cand::INTEGER AS cand_id, round(weight, 6) AS weight FROM n_top""", ["n_top"])
def i3(spark, d):
    cands, ready = swaps(spark, d)
    return nb.top_neighbors(cands).select("doc_id", "begin", "rank", "pos", "cand_id", rnd("weight"))


@query("i4_apply_replacement", """
  SELECT doc_id, begin::INTEGER AS begin, rank::INTEGER AS rank,
         md5(string_agg(CASE WHEN s.pos = n.pos THEN n.cand ELSE s.token_id END, ' ' ORDER BY s.pos)) AS sequence_md5
  FROM n_top n JOIN n_pos s USING (doc_id, begin) GROUP BY doc_id, begin, rank""", ["n_top", "n_pos"])
def i4(spark, d):
    cands, ready = swaps(spark, d)
    rows = tk.explode_windows(ready.tokens)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda e: e["token_id"])
    sequences = rows.groupBy("doc_id", "begin").agg(ids.alias("sequence"))
    swapped = nb.apply_replacement(sequences, nb.top_neighbors(cands))
    text = F.array_join(F.col("sequence").cast("array<string>"), " ")
    return swapped.select("doc_id", "begin", "rank", F.md5(F.encode(text, "UTF-8")).alias("sequence_md5"))


@query("i5_mean_logprob", f"""
  SELECT doc_id, begin::INTEGER AS begin,
         round(avg(-s) FILTER (s <> 0), 6) AS mean_logprob
  FROM wrows GROUP BY doc_id, begin""", ["wrows"])
def i5(spark, d):
    rows = tk.explode_windows(scored_docs(spark, d, ["si"])).filter(F.col("pos") >= F.col("begin"))
    rows = rows.withColumn("logp", F.when(F.col("pos") > F.col("begin"), -F.col("nll")))
    return nb.mean_logprob(rows).select("doc_id", "begin", rnd("mean_logprob"))


block("n_score", ["n_top", "wrows", "m_terms", "m_ctx", "m_uni"], """
  SELECT doc_id, begin, count(*) AS n_neighbors,
         sum(v1 + coalesce(v2, 0) - nll - coalesce(nll_next, 0)) / (count(*) * any_value(n)) AS score
  FROM (
    SELECT n.doc_id, n.begin, n.nll, n.nll_next, w.n,
           -ln(coalesce(x1.b, 0) + coalesce(c1.keep, 1.0) * u1.u) AS v1,
           CASE WHEN n.next <> 2 THEN -ln(coalesce(x2.b, 0) + coalesce(c2.keep, 1.0) * u2.u) END AS v2
    FROM n_top n JOIN (SELECT doc_id, begin, count(s) AS n FROM wrows GROUP BY ALL) w USING (doc_id, begin)
    LEFT JOIN m_terms x1 ON x1.prev = n.prev AND x1.token_id = n.cand
    LEFT JOIN m_ctx c1 ON c1.prev = n.prev JOIN m_uni u1 ON u1.token_id = n.cand
    LEFT JOIN m_terms x2 ON x2.prev = n.cand AND x2.token_id = n.next
    LEFT JOIN m_ctx c2 ON c2.prev = n.cand LEFT JOIN m_uni u2 ON u2.token_id = n.next)
  GROUP BY doc_id, begin""")


def neighbourhood(spark, d):
    cands, ready = swaps(spark, d)
    return nb.neighborhood_score(nb.top_neighbors(cands), ready.model, all_windows(spark, d))


@query("i6_neighborhood_score", """
  SELECT doc_id, begin::INTEGER AS begin, coalesce(n_neighbors, 0) AS n_neighbors,
         round(score, 6) AS neighborhood_score
  FROM win LEFT JOIN n_score USING (doc_id, begin)""", ["win", "n_score"])
def i6(spark, d):
    return neighbourhood(spark, d).select("doc_id", "begin", "n_neighbors", rnd("neighborhood_score"))


@query("i6_score_column", """
  SELECT 'doc_' || doc_id AS doc_id, begin::INTEGER AS begin, round(exp(loss), 4) AS ppl,
         round(score, 6) AS neighborhood_score
  FROM wloss LEFT JOIN n_score USING (doc_id, begin)""", ["wloss", "n_score"])
def i6_column(spark, d):
    table = bl.score_table(losses(spark, d), with_zlib=False)
    score = neighbourhood(spark, d).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"), "begin", "neighborhood_score")
    return table.join(score, ["doc_id", "begin"], "left").select(
        "doc_id", "begin", rnd("ppl", digits=4), rnd("neighborhood_score"))
