"""Registered queries and the SQL that checks them.

``@query(name, sql, uses)`` registers a Spark query; ``sql`` may build on the
named blocks below, which are put in front of it as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk
from inkprobe.sources import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, uses: Sequence[str], sql: str) -> None:
    BLOCKS[name] = (tuple(uses), sql.strip())


def compose(sql: str, uses: Sequence[str]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in BLOCKS[name][0]:
                visit(dep)
            order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in order) + "\n" + sql.strip()


def query(name: str, sql: str | None = None, uses: Sequence[str] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = compose(sql, uses)
        return fn
    return register


# ------------------------------------------------------- shared Spark inputs

def rnd(col: Column | str, name: str | None = None, digits: int = 6) -> Column:
    out = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return out.alias(name or col)


def pool_no() -> Column:
    return F.substring("source", 4, 9).cast("int")


def is_member() -> Column:
    return F.col("si") < 8


def is_non_member() -> Column:
    return (F.col("si") >= 8) & (F.col("si") < 16)


def is_reference() -> Column:
    return F.col("si") >= 16


def documents(spark: SparkSession, d: str) -> DataFrame:
    return corpora.text_table(spark, d, "documents", "doc_id").select(
        "doc_id", "text", "lang", "source", pool_no().alias("si"))


@dataclass(frozen=True)
class Prepared:
    """What later steps read: vocabulary, documents as arrays, their tokens (narrow over these) and count model."""

    vocab: DataFrame
    corpus: DataFrame
    tokens: DataFrame
    model: sc.CountModel


def prepare(spark: SparkSession, d: str, keep: Sequence[str] = ("si",), with_ref: bool = False,
            with_next: bool = False, **options: bool) -> Prepared:
    """Tokenise ``documents`` and train on the member pool, writing each stage once."""
    docs = documents(spark, d)
    vocab, corpus = tk.vocab_and_corpus(docs, list(keep), **options)
    tokens = tk.token_rows(corpus, list(keep), with_next)
    pools = {"target": is_member()}
    if with_ref:
        pools["reference"] = is_reference()
    return Prepared(vocab, corpus, tokens, sc.train(corpus, vocab, pools, store=True))


def scored_docs(spark: SparkSession, d: str, keep: Sequence[str] = ("si", "lang")) -> DataFrame:
    """Loss of every position of every document under the member model."""
    ready = prepare(spark, d, keep)
    return sc.score_tokens(ready.corpus, ready.model)


# ------------------------------------------------------------- shared blocks

WORDS_SQL = tk.WORD_PATTERN
LAM, KEEP = params.LAMBDA, 1 - params.LAMBDA

block("split", [], rf"""
  SELECT doc_id, lang, source, CAST(substr(source, 4) AS INTEGER) AS si, text,
         regexp_extract_all(text, '{WORDS_SQL}') AS w
  FROM documents""")
block("lengths", ["split"], "SELECT doc_id, lang, source, si, len(w) AS n_tokens FROM split")
block("win", ["lengths"], f"""
  SELECT doc_id, n_tokens, unnest(range(0, n_tokens, {params.STRIDE}))::INTEGER AS begin FROM lengths""")
block("tok", ["split"], """
  SELECT doc_id, lang, source, si, len(w) AS n_tokens, unnest(w) AS word,
         generate_subscripts(w, 1) - 1 AS pos
  FROM split""")
block("vocab", ["tok"], f"""
  SELECT word AS token, count(*) AS n,
         row_number() OVER (ORDER BY count(*) DESC, word) + {params.N_RESERVED - 1} AS token_id
  FROM tok GROUP BY word""")
block("ids", ["tok", "vocab"], f"""
  SELECT doc_id, lang, source, si, n_tokens, pos, word,
         coalesce(token_id, {params.UNK}) AS token_id
  FROM tok LEFT JOIN vocab ON word = token""")
block("t", ["ids"], f"""
  SELECT *, coalesce(lag(token_id) OVER w, {params.BOS}) AS prev,
         coalesce(lead(token_id) OVER w, {params.EOS}) AS next
  FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")


def _model_blocks(prefix: str, condition: str) -> None:
    block(f"{prefix}pairs", ["t"], f"""
      SELECT prev, token_id, count(*) AS n FROM t WHERE {condition} GROUP BY prev, token_id""")
    block(f"{prefix}ctx", [f"{prefix}pairs"], f"""
      SELECT prev, sum(n) AS c, {KEEP} AS keep FROM {prefix}pairs GROUP BY prev""")
    block(f"{prefix}terms", [f"{prefix}pairs", f"{prefix}ctx"], f"""
      SELECT prev, token_id, n, {LAM} * CAST(n AS DOUBLE) / c AS b
      FROM {prefix}pairs JOIN {prefix}ctx USING (prev)""")
    block(f"{prefix}uni", [f"{prefix}pairs", "vocab"], f"""
      SELECT e.token_id,
             (coalesce(sum(p.n), 0) + 1)::DOUBLE
               / ((SELECT sum(n) FROM {prefix}pairs) + (SELECT count(*) + 1 FROM vocab)) AS u
      FROM (SELECT token_id FROM vocab UNION ALL SELECT {params.UNK}) e
      LEFT JOIN {prefix}pairs p ON p.token_id = e.token_id
      GROUP BY e.token_id""")


_model_blocks("m_", "si < 8")
_model_blocks("r_", "si >= 16")

block("scored", ["t", "m_terms", "m_ctx", "m_uni"], """
  SELECT t.doc_id, t.lang, t.source, t.si, t.n_tokens, t.pos, t.token_id, t.prev, t.next,
         -ln(coalesce(b, 0) + coalesce(keep, 1.0) * u) AS nll
  FROM t
  LEFT JOIN m_terms x ON x.prev = t.prev AND x.token_id = t.token_id
  LEFT JOIN m_ctx c ON c.prev = t.prev
  JOIN m_uni u ON u.token_id = t.token_id
  WHERE t.pos > 0""")
block("m_best", ["m_terms", "m_ctx", "m_uni"], """
  SELECT prev, greatest(max(b + keep * u), max(keep) * (SELECT max(u) FROM m_uni)) AS max_p
  FROM m_terms JOIN m_ctx USING (prev) JOIN m_uni USING (token_id) GROUP BY prev""")

block("best_u", ["m_uni"], f"""
  SELECT token_id, u, row_number() OVER (ORDER BY u DESC, token_id) AS r FROM m_uni
  QUALIFY r <= {params.TOP_K}""")
block("cls", ["lengths"], f"""
  SELECT doc_id, CASE WHEN si < 8 THEN 1 ELSE 0 END AS label
  FROM lengths WHERE si < 16 AND n_tokens > {params.MIN_TOKENS}""")
block("per", ["cls"], f"""
  SELECT CAST(floor(min(n) / {params.N_CHUNKS}) AS BIGINT) AS p
  FROM (SELECT count(*) AS n FROM cls GROUP BY label)""")
block("chunks", ["cls", "per"], f"""
  SELECT doc_id, CAST((rn - 1) // p AS INTEGER) AS chunk_id,
         CAST((rn - 1) % p + CASE WHEN label = 0 THEN p ELSE 0 END AS INTEGER) AS row_in_chunk, label
  FROM (SELECT *, row_number() OVER (PARTITION BY label
                  ORDER BY md5('{params.SEED}:' || doc_id), doc_id) AS rn FROM cls), per
  WHERE rn <= {params.N_CHUNKS} * p""")
block("ctok", ["t", "chunks"], "SELECT t.*, chunk_id, label FROM t JOIN chunks USING (doc_id)")
block("cscored", ["scored", "chunks", "m_best"], """
  SELECT s.doc_id, chunk_id, label, pos, token_id, nll,
         coalesce(max_p, (SELECT max(u) FROM m_uni)) AS max_p
  FROM scored s JOIN chunks USING (doc_id) LEFT JOIN m_best USING (prev)""")
block("csize", ["ctok"], "SELECT chunk_id, count(*) AS tokens FROM ctok GROUP BY chunk_id")
block("tf", ["ctok"], """
  SELECT chunk_id, token_id, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY chunk_id) AS value
  FROM ctok GROUP BY chunk_id, token_id""")
block("cw", ["ctok"], """
  SELECT chunk_id, doc_id, prev,
         count(*) AS slots, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS weight
  FROM ctok WHERE pos > 0 GROUP BY chunk_id, doc_id, prev""")
block("gw", ["cw"], """
  SELECT chunk_id, prev, sum(weight) / any_value(d) AS weight
  FROM cw JOIN (SELECT chunk_id, count(DISTINCT doc_id) AS d FROM cw GROUP BY chunk_id) USING (chunk_id)
  GROUP BY chunk_id, prev""")
block("gp", ["gw", "m_terms", "m_ctx", "m_uni"], """
  SELECT chunk_id, token_id, sum(value) AS value FROM (
    SELECT chunk_id, token_id, weight * b AS value FROM gw JOIN m_terms USING (prev)
    UNION ALL
    SELECT chunk_id, token_id, mass * u AS value
    FROM (SELECT chunk_id, sum(weight * coalesce(keep, 1.0)) AS mass
          FROM gw LEFT JOIN m_ctx USING (prev) GROUP BY chunk_id), m_uni)
  GROUP BY chunk_id, token_id""")
block("folds", [], f"SELECT unnest(range({params.N_CHUNKS}))::INTEGER AS fold")


def _norm_blocks(name: str, source: str) -> None:
    block(f"fn_{name}", [source, "csize", "folds"], f"""
      SELECT fold, token_id, sum(value * tokens) / any_value(total) AS value
      FROM {source} JOIN csize USING (chunk_id) JOIN folds ON fold <> chunk_id
      JOIN (SELECT fold, sum(tokens) AS total FROM csize JOIN folds ON fold <> chunk_id GROUP BY fold)
        USING (fold)
      GROUP BY fold, token_id""")
    block(f"nl_{name}", [f"fn_{name}", "cscored", "folds"], f"""
      SELECT f.fold, s.*, coalesce(n.value, low.value) AS norm,
             CASE WHEN s.chunk_id = f.fold THEN 'test' ELSE 'train' END AS role
      FROM cscored s CROSS JOIN folds f
      LEFT JOIN fn_{name} n ON n.fold = f.fold AND n.token_id = s.token_id
      JOIN (SELECT fold, min(value) / 2 AS value FROM fn_{name} GROUP BY fold) low ON low.fold = f.fold""")
    block(f"ratio_{name}", [f"nl_{name}"], f"""
      SELECT *, CASE WHEN exp(-nll) = 0 OR norm <= 0 THEN {params.GUARD_VALUE}
                     ELSE -ln(exp(-nll) / norm) END AS value
      FROM nl_{name}""")
    block(f"diff_{name}", [f"nl_{name}"], f"""
      SELECT *, CASE WHEN 1 - (max_p - exp(-nll)) <= 0 OR norm <= 0 THEN {params.GUARD_VALUE}
                     ELSE -ln((1 - (max_p - exp(-nll))) / norm) END AS value
      FROM nl_{name}""")


_norm_blocks("tf", "tf")
_norm_blocks("gp", "gp")


def agg_sql(source: str, by: str) -> str:
    """The aggregate features of ``value`` by the given columns."""
    shares = ", ".join(str(p / 100) for p in params.PERCENTILES)
    picks = ", ".join(f"q[{i + 1}] AS perc_{p}" for i, p in enumerate(params.PERCENTILES))
    return f"""
      SELECT {by}, "mean", "min", "max", "std", "count", {picks} FROM (
        SELECT {by}, avg(value) AS "mean", min(value) AS "min", max(value) AS "max",
               stddev_pop(value) AS "std", count(value)::DOUBLE AS "count",
               quantile_cont(value, [{shares}]) AS q
        FROM {source} GROUP BY {by})"""


def rounded_sql(cols: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)
