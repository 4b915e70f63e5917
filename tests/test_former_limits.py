"""Inputs beyond limits that defaults used to have, and results that used to be wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.operators import books, catalogue
from inkprobe.operators import neighbours as nb
from inkprobe.operators import normalise as nm
from inkprobe.operators import sampling as sp
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk


def test_vocabulary_keeps_every_word(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.col("id") * 50, F.col("id") * 50 + 49), lambda i: F.concat(F.lit("w"), i.cast("string")))).alias("text"))
    vocab = tk.build_vocab(docs)
    got = vocab.agg(F.count("*"), F.min("token_id"), F.max("token_id"), F.countDistinct("token_id")).first()
    assert got[:] == (35_000, 3, 35_002, 35_000) and 35_000 > params.VOCAB_SIZE
    assert tk.token_table(docs, vocab).filter("token_id = 0").count() == 0


def test_a_vocabulary_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"The cat {i} sat on the mat {'x ' * (i % 4)}" if i else "") for i in range(40)], "doc_id bigint, text string")
    vocab = tk.build_vocab(docs).cache()

    def everything():
        tokens = tk.token_table(docs, vocab, with_next=True, lower=True)
        model = sc.train(tokens, vocab, {"target": F.lit(True)})
        out = [sorted(map(str, df.collect())) for df in (
            tokens, tk.tokenize(docs, vocab), tk.decode(tokens, vocab, ["doc_id"]),
            sc.score_tokens(tokens, model, 8, 7).withColumn("nll", F.round("nll", 9)))]
        return out

    near = everything()
    monkeypatch.setattr(params, "MAX_BROADCAST_ROWS", 5)
    assert not tk.fits(vocab)
    assert everything() == near


def test_filters_keep_more_rows_than_the_old_caps(spark):
    rows = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("1900").alias("y"), F.lit(500).alias("n_tokens"))
    assert sp.filter_year(rows, "y").count() == 20_500
    assert sp.min_tokens(rows).count() == 20_500
    assert sp.filter_year(rows, "y", cap=100).count() == 100


def test_release_date_far_down_the_header(spark):
    raw = ("Title: x\n" + "é" * 1_500 + "\nRelease Date: March 5, 2023\n*** START\nRelease Date: May 1, 1999\n*** END").encode()
    df = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert df.select(books.release_date(books.header_of(F.col("content")))).first()[0] == dt.date(2023, 3, 5)


def test_long_windows_are_swapped_and_scored_to_their_end(spark):
    tokens = spark.range(600).selectExpr("0L AS doc_id", "CAST(id AS INT) AS pos", "600 AS n_tokens", "3 AS token_id",
                                         "3 AS prev", "3 AS next")
    assert nb.swap_positions(tokens, 600, 599).filter("begin = 0").count() == 599
    scores = spark.range(600).selectExpr("0L AS doc_id", "0 AS begin", "id AS pos", "CAST(IF(id < 512, -1, -3) AS DOUBLE) AS logp")
    assert math.isclose(nb.mean_logprob(scores).first()["mean_logprob"], -(512 + 3 * 88) / 600)


def test_all_items_of_a_listing(spark):
    html = "".join(f'<li><a href="/ebooks/{i}">b{i}</a></li>' for i in range(150))
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    assert catalogue.list_links(df).count() == 150 and catalogue.list_links(df, limit=7).count() == 7


def test_many_header_lines(spark):
    text = "".join(f"k{i % 500}: v{i}\n" for i in range(5_000)) + "*** START\nbody\n*** END"
    got = books.parse_books(spark.createDataFrame([(1, text)], "id int, text string")).first()["metadata"]
    assert got == {f"k{i}": f"v{4_500 + i}" for i in range(500)}


# -------------------------------------------------------- results once wrong

def test_an_absent_class_or_an_empty_population_is_an_error(spark):
    df = spark.createDataFrame([(i, 200) for i in range(40)], "doc_id bigint, n_tokens int")
    with pytest.raises(ValueError, match="classes"):
        sp.split_chunks(df, df.limit(0))
    with pytest.raises(ValueError, match="classes"):
        sp.split_chunks(df, df.limit(0), n_pos=3)
    with pytest.raises(ValueError, match="sample larger"):
        sp.sample_n(df.limit(0), 5)


RECORD = ('<div{id}><div class="a"><DIV>x</DIV></div><table><tr property="dcterms:language"><td>English</td></tr>'
          '<tr><td itemprop="interactionCount">12 downloads</td></tr></table></div><div><td itemprop="interactionCount">9 </td></div>')


@pytest.mark.parametrize("attribute, found", [
    (' id="bibrec"', True), (" class='c' id='bibrec'", True), (" id=bibrec", True), (' ID = "bibrec" x', True),
    (' data-id="bibrec"', False), (' id="bibrec2"', False)])
def test_record_block_reaches_its_own_end(spark, attribute, found):
    df = spark.createDataFrame([(1, "<p>" + RECORD.format(id=attribute))], "page_id bigint, html string")
    row = catalogue.page_downloads(catalogue.page_metadata(df)).first()
    assert (row["language"], row["downloads"]) == (("English", 12) if found else (None, 0))


def test_guard_catches_negative_infinity(spark):
    rows = spark.createDataFrame([(0.1, 1e-320, 0.5), (0.1, 0.5, 0.5), (None, 0.5, 0.5)], "nll double, norm double, max_p double")
    for kind in ("ratio", "diff_max_token_proba"):
        values = [r["value"] for r in nm.normalize(rows, kind).collect()]
        assert values[0] == params.GUARD_VALUE and math.isfinite(values[1]) and values[2] is None


def test_equal_document_ids_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="must be unique"):
        tk.tokenize(docs, tk.build_vocab(docs)).collect()


def test_windows_without_swaps_have_a_null_score(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a b c d")], "doc_id bigint, text string")
    vocab = tk.build_vocab(docs).cache()
    tokens = tk.token_table(docs, vocab, with_next=True).cache()
    model = sc.train(tokens, vocab, {"target": F.lit(True)})
    masked = sc.train(tokens, vocab, {"target": F.lit(True)}, ctx=("prev", "next"))
    pos = nb.swap_positions(tokens)
    swaps = nb.top_neighbors(nb.candidates(pos, nb.triple_options(pos, masked, model)))
    windows = tk.sequence_windows(tk.doc_lengths(docs))
    got = {r["doc_id"]: r for r in nb.neighborhood_score(swaps, model, windows).collect()}
    assert got[1]["neighborhood_score"] is None and got[1]["n_neighbors"] == 0
    assert got[2]["neighborhood_score"] is not None
