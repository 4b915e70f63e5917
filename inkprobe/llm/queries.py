"""The registered queries of this folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprobe.llm import (
    decontaminate,
    exact_dedup,
    language,
    licenses,
    pii,
    quantised,
    sentencepieces,
    shards,
    simhash,
    tokens_file,
    toxicity,
    whitening,
    zonemaps,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
N_SHARDS = 8

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shards.shard(docs, N_SHARDS)
    return placed.select(
        F.col("rec.doc_id").alias("doc_id"), shards.text_size("rec.text").alias("size"),
        shards.text_crc32("rec.text").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens_file.write(_table(spark, sf_dir, "documents"), BYTE_BPE)
    return tokens_file.read(manifest)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _fold(n: int) -> Column:
    """Checksum of the key as text, modulo ``n``: the rows that models may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(_fold(4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_and_decode(_table(spark, sf_dir, "documents"), PIECES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learn = docs.filter(_fold(5) != 0)
    speak = language.train(learn)
    net = toxicity.train(learn, labels.filter(_fold(5) != 0), speak)
    found = toxicity.score(docs, net, speak)
    return found.select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.count_of("base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find(_table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.col("matches.coverage")), F.lit(0.0))
    return found.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"), best.alias("best_coverage"),
        licenses.listed().alias("spans"), "matches")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model) if model else None
    return whitening.whiten(vectors, model).withColumn("identity_error", F.lit(error).cast("double"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.assign(zonemaps.fit(_table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    q.__name__: q for q in (
        op1_decontamination, op2_sharding, op3_token_ids, op4_exact_dedup, op5_simhash, op6_language,
        op7_sentencepiece, op8_toxicity, op9_pii, op10_licenses, op11_whitening, op12_embedding_dedup,
        op13_centroids, pipeline)
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _centroid_sql() -> str:
    """All rounds over (row, axis, value), one pair of table expressions a round."""
    width, k = zonemaps.WIDTH, zonemaps.CENTROIDS
    parts = [f"""v AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: floor({zonemaps.FACTOR} * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"x AS MATERIALIZED (SELECT vec_id, unnest(range({width})) AS i, unnest(e) AS x FROM v)",
             f"""c0 AS MATERIALIZED (
        SELECT c, unnest(range({width})) AS i, unnest(e) AS y FROM (
          SELECT row_number() OVER (ORDER BY sha256('{zonemaps.SEED}:' || vec_id)) - 1 AS c, e FROM v)
        WHERE c < {k})"""]
    for r in range(zonemaps.ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
        SELECT vec_id, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
          SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY vec_id, c)
        GROUP BY vec_id)""")
        if r < zonemaps.ROUNDS:
            # The remainder is made positive first, so that the division has no rest.
            parts.append(f"""c{r + 1} AS MATERIALIZED (
        SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.y)::BIGINT AS y FROM c{r} o LEFT JOIN (
          SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, i) m
        ON m.c = o.c AND m.i = o.i)""")
    last = zonemaps.ROUNDS
    return f"""
      WITH {", ".join(parts)}
      SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
             (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
      FROM a{last} JOIN (SELECT c, sha256(string_agg(y, ',' ORDER BY i)) AS h FROM c{last} GROUP BY c) USING (c)"""


TWINS: dict[str, str] = {
    "op1_decontamination": rf"""
      WITH d AS (SELECT doc_id, regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
                 FROM documents),
      b AS (SELECT item_id, regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
            FROM benchmark),
      windows AS (
        SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
        FROM (SELECT item_id, w, least(13, len(w)) AS m,
                     unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT m FROM windows),
      spots AS (
        SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
      found AS (SELECT doc_id, item_id, i, a.m FROM spots a JOIN windows v ON a.win = v.win AND a.m = v.m),
      hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
      items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
      SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
             coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
             coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
      FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_exact_dedup": r"""
      WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
                 FROM documents)
      SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
             doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
      FROM d WINDOW g AS (PARTITION BY h)""",
    "op12_embedding_dedup": f"""
      WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      link AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= {quantised.THRESHOLD}),
      reach AS (
        SELECT vec_id AS x, vec_id AS y FROM embeddings
        UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
      SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
      FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
      LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY x) USING (vec_id)""",
    "op13_centroids": _centroid_sql(),
}
