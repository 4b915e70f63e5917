"""Blocks of rows ask for each of their distinct keys once."""

import math

import pytest
from pyspark.sql import functions as F

from inkprobe.functions import blocks
from inkprobe.operators import neighbours as nb
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["a", "b"] * (i % 40) + [f"w{i % 7}", f"x{i}"])) for i in range(120)]
    return spark.createDataFrame([*rows, (5, "a c a"), (None, "b a"), (900, ""), (901, None)], "doc_id bigint, text string")


def test_blocks_ask_once(spark):
    rows = spark.createDataFrame([(i, ["k1", None, f"k{i}", "k1"]) for i in range(40)] + [(99, None)], "id int, keys array<string>")
    table = spark.createDataFrame([(f"k{i}", i, [float(i)]) for i in range(30)], "k string, v int, l array<double>")
    stored = blocks.store_blocks(rows, F.lit(100), ["id", "keys"], "test", block_bytes=500)
    assert stored.select("_block").distinct().count() > 1
    found = blocks.look_up(stored, [blocks.Find("keys", table, "k", {"v": "vs", "l": "ls"})])
    for r in found.collect():
        want = [int(k[1:]) if k and int(k[1:]) < 30 else None for k in r["keys"] or []]
        assert r["vs"] == want and r["ls"] == [None if w is None else [float(w)] for w in want]


def test_documents_score_as_their_tokens_do_and_tokens_do_not_move(spark, docs):
    vocab = tk.build_vocab(docs).cache()
    corpus = tk.encode(docs, vocab)
    tokens = tk.token_rows(corpus).cache()
    model = sc.train(tokens, vocab, {"target": F.col("doc_id") % 2 == 0}, store=True)
    columns = ["doc_id", "pos", "token_id", "prev", F.round("nll", 12).alias("nll"), F.round("max_p", 12).alias("max_p")]
    for context, stride in ((8, 7), (6, 9)):
        by_block = sc.score_tokens(corpus, model, context, stride, max_p=True)
        by_row = sc.score_tokens(tokens, model, context, stride, max_p=True)
        assert sorted(map(str, by_block.select(*columns).collect())) == sorted(map(str, by_row.select(*columns).collect()))
    # Tokens come out of their documents after the last shuffle.
    plan = sc.score_tokens(corpus, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange")
    assert "Exchange" not in tk.token_table(docs, vocab)._jdf.queryExecution().executedPlan().toString()


def test_a_task_sends_each_key_of_a_block_once(spark):
    rows = spark.createDataFrame([(7, i, ["k1", None, "k2", f"k{i % 3}"]) for i in range(50)],
                                 "_block long, id int, keys array<string>").coalesce(1)
    asked = rows.select("_block", "keys").mapInArrow(
        lambda batches: blocks._distinct(batches, False, blocks.pa.string()), "_block bigint, _key string").collect()
    assert sorted(asked) == [(7, "k0"), (7, "k1"), (7, "k2")]


def test_words_are_split_once_for_vocabulary_and_ids(spark, docs):
    for size in (3, 10_000):
        coded = tk.code_words(docs, block_tokens=size)
        assert sorted(tk.vocab_of(coded).collect()) == sorted(tk.build_vocab(docs).collect())
        vocab = tk.build_vocab(docs, size=20).cache()
        got = tk.encode_coded(coded, vocab, lower=True, with_word=True)
        number = {r["token"]: r["token_id"] for r in vocab.collect()}
        for r in got.collect():
            assert r["input_ids"] == [number.get(w, 0) for w in r["words"]]
            assert r["low_ids"] == [number.get(w.lower(), 0) for w in r["words"]]
        want = docs.select("doc_id", F.coalesce(tk.words("text"), F.array().cast("array<string>")).alias("words"))
        assert sorted(map(str, got.select("doc_id", "words").collect())) == sorted(map(str, want.collect()))


def test_windows_and_contexts_stay_with_their_documents(spark, docs):
    from inkprobe.operators import baselines as bl

    vocab, corpus = tk.vocab_and_corpus(docs, lower=True)
    model = sc.train(corpus, vocab, {"target": F.col("doc_id") % 2 == 0, "reference": F.col("doc_id") % 3 == 0}, store=True)
    windows = bl.window_losses(corpus, model, 8, 7)
    long = tk.explode_windows(sc.score_tokens(tk.token_rows(corpus), model, 8, 7), 8, 7).filter("pos > begin")
    want = long.groupBy("doc_id", "begin").agg(F.count("*").alias("n"), F.round(F.avg("nll"), 9).alias("loss"))
    got = windows.filter("n > 0").select("doc_id", "begin", "n", F.round("loss", 9).alias("loss"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    single = bl.window_losses(corpus.filter("doc_id <> 5"), model)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in single

    columns = ["doc_id", "prev", "slots", F.round("weight", 9).alias("weight")]
    narrow = sc.doc_general_proba(corpus, context=8, stride=7).select(*columns)
    by_token = sc.doc_general_proba(tk.token_rows(corpus), context=8, stride=7).select(*columns)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, by_token.collect()))
    mass = lambda w: sorted(map(str, sc.doc_background(w, model).select("doc_id", F.round("background", 9)).collect()))
    assert mass(sc.doc_contexts(corpus, (), 8, 7)) == mass(sc.doc_general_proba(tk.token_rows(corpus), (), 8, 7))


def _shuffled(df):
    """Columns that each shuffle of a plan carries."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_pairs_meet_no_context_before_their_block(spark, docs):
    """Blocks get counts and totals; the stored pairs are shuffled once, to the blocks that ask."""
    vocab, corpus = tk.vocab_and_corpus(docs)
    model = sc.train(corpus, vocab, {"target": F.col("doc_id") % 2 == 0}, lam=0.3, store=True)
    got = sc.document_losses(corpus, model)
    exchanges, plan = _shuffled(got)
    assert "keep_target" not in plan and "b_target" not in plan
    terms = {(r["prev"], r["token_id"]): r["b_target"] for r in model.terms.collect()}
    keeps = {r["prev"]: r["keep_target"] for r in model.contexts.collect()}
    u = {r["token_id"]: r["u_target"] for r in model.unigrams.collect()}
    for r in got.collect():
        ids = r["input_ids"]
        want = [-math.log(terms.get((a, t), 0.0) + keeps.get(a, 1.0) * u[t]) for a, t in zip(ids, ids[1:])]
        assert r["nll"][:1] in ([], [None]) and r["nll"][1:] == pytest.approx(want, abs=1e-12)


def test_what_hot_keys_find_does_not_travel(spark):
    """The wide answers of hot keys are joined after the shuffle of the rows that ask."""
    from inkprobe.functions.skew import lookup_join

    left = spark.range(400).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(i, [float(i)] * 4) for i in range(2)], "k long, top array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup_join(left, right, ["k"], ["top"], ["id"], slots=10)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin"), plan
        got = {r["id"]: r["top"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: [float(i % 3)] * 4 if i % 3 < 2 else None for i in range(400)}


def test_sequences_of_single_documents_do_not_move(spark, docs):
    from inkprobe.operators import ngrams as ng

    _, corpus = tk.vocab_and_corpus(docs)
    want = ng.sequences(tk.token_rows(corpus))
    assert sorted(map(str, ng.sequences(corpus).collect())) == sorted(map(str, want.collect()))
    single = ng.sequences(corpus.filter("doc_id <> 5"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_resolved_where_a_document_lies(spark, docs):
    vocab = tk.build_vocab(docs).cache()
    corpus = tk.encode(docs, vocab)
    model = sc.train(corpus, vocab, {"target": F.lit(True)}, store=True)
    scored = sc.score_tokens(corpus, model).cache()
    for context, stride in ((8, 4), (4, 6)):
        rows = tk.explode_windows(scored, context, stride, early_stop=True).filter("pos > begin")
        want = sc.resolve_overlaps(rows.withColumn("nll", F.col("nll") * 100 + (F.col("pos") - F.col("begin"))))
        found = sc.resolve_documents(
            corpus, model, lambda b: F.col("nll") * 100 + (F.col("pos") - b), context, stride).cache()
        keys = ["doc_id", "pos", "begin"]
        listed = lambda df, *c: sorted(map(str, df.select(*keys, *c).collect()))
        assert listed(found) == listed(want)
        value = F.round("nll", 9).alias("nll")
        other = ~F.col("doc_id").eqNullSafe(5)  # two documents have this id
        assert listed(found.filter(other), value) == listed(want.filter(other), value)
    # Only documents that share their id move once they are scored.
    alone = sc.resolve_documents(corpus.filter(~F.col("doc_id").eqNullSafe(5)), model, lambda b: F.col("nll"), 8, 4)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("FlatMapCoGroupsInArrow")]


def test_contexts_of_two_tokens_are_counted_where_documents_lie(spark, docs):
    vocab = tk.build_vocab(docs).cache()
    corpus = tk.encode(docs, vocab)
    tokens = tk.token_rows(corpus, with_next=True).cache()
    pools = {"target": F.col("doc_id") % 2 == 0, "other": F.col("doc_id") % 3 == 0}
    ctx = ("prev", "next")
    by_row = sc.train(tokens, vocab, pools, ctx, store=True)
    by_document = sc.train(corpus, vocab, pools, ctx, store=True)
    for part in ("counts", "contexts", "unigrams", "terms"):
        found, want = getattr(by_document, part), getattr(by_row, part)
        assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # Totals of contexts need no further shuffle.
    assert "Exchange" not in by_document.contexts._jdf.queryExecution().executedPlan().toString()
    for context, stride, most in ((8, 7, None), (8, 3, None), (4, 6, None), (8, 4, 5), (1, 1, None)):
        rows = nb.swap_positions(tokens, context, stride, most)
        found = nb.swap_contexts(corpus, context, stride, most)
        want = rows.groupBy("prev", "next").count()
        assert sorted(found.groupBy("prev", "next").agg(F.sum("n")).collect()) == sorted(want.collect())
        assert sorted(nb.context_shares(found, by_document).collect()) == sorted(nb.context_shares(rows, by_row).collect())


def test_only_documents_that_share_their_id_move_for_tokenize(spark, docs):
    named = docs.withColumn("tag", F.coalesce(F.col("doc_id"), F.lit(-1)) % 3)
    once = named.filter("doc_id IS NULL OR doc_id <> 5")
    vocab = tk.build_vocab(docs).cache()
    rows = tk.tokenize(once, vocab)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r["doc_id"]: r for r in rows.collect()}
    number = {r["token"]: r["token_id"] for r in vocab.collect()}
    for r in once.collect():
        want = [number[w] for w in (r["text"] or "").split()] if r["doc_id"] is not None else []
        assert (got[r["doc_id"]]["input_ids"], got[r["doc_id"]]["tag"]) == (want, r["tag"])
        assert got[r["doc_id"]]["attention_mask"] == [1] * len(want)
    # Rows of one id of which one has a token all get it; two that have tokens are an error.
    empty = spark.createDataFrame([(7, ""), (7, None)], "doc_id long, text string").withColumn("tag", F.lit(9).cast("long"))
    shared = [r["input_ids"] for r in tk.tokenize(once.unionByName(empty), vocab).filter("doc_id = 7").collect()]
    assert len(shared) == 3 and len(set(map(tuple, shared))) == 1 and shared[0]
    with pytest.raises(Exception, match="document ids must be unique"):
        tk.tokenize(named, vocab).collect()


def test_rows_of_a_document_do_not_hold_its_arrays(spark, docs):
    """What is taken of a whole document is taken before its rows are made."""
    from inkprobe.operators import ngrams as ng

    vocab, corpus = tk.vocab_and_corpus(docs)
    model = sc.train(corpus, vocab, {"target": F.lit(True)}, store=True)
    overlaps = sc.resolve_documents(corpus.filter(~F.col("doc_id").eqNullSafe(5)), model, lambda b: F.col("nll"), 8, 4)
    grams = ng.scored_grams(ng.gram_table(ng.sequences(corpus), 3), 3, 8, 7)
    for rows in (overlaps, grams, sc.score_tokens(corpus, model)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        made = [line for line in plan.splitlines() if "Generate" in line]
        assert len(made) == 1 and "input_ids" not in made[0] and "nll" not in made[0], plan


def test_blocks_are_worked_on_by_parts(spark, docs, monkeypatch):
    """No step takes all tokens of a block or batch at once, and the parts give what the whole gave."""
    import numpy as np
    import pyarrow as pa

    lists = pa.table({"k": pa.array([[1, 2, 3], None, [], [4] * 9, [5], [6, 7]]), "at": np.arange(6)})
    parts = [p.column("at").to_pylist() for p in blocks.sliced(lists, "k", 4)]
    assert parts == [[0, 1, 2], [3], [4, 5]]
    assert [p.column("at").to_pylist() for p in blocks.sliced(lists.slice(2), 0, 4)] == [[2], [3], [4, 5]]
    table = pa.table({"_find": pa.array([0, 0, 1], pa.int32()), "_key": pa.array([1, 4, (6 << 32) | 7], pa.int64()),
                      "_v0_double": [.1, .4, None], "_v0_bigint": pa.array([None, None, 67], pa.int64())})
    asked = [({"k": ["a"]}, False), ({"k": ["b"]}, True)]
    sizes = []
    monkeypatch.setattr(blocks, "SLICE", 4)
    for part in blocks._filled(lists, table, asked, [["_v0_double"], ["_v0_bigint"]]):
        sizes.append(sum(len(k or []) for k in part.column("k").to_pylist()))
        for k, a, b in zip(*[part.column(c).to_pylist() for c in "kab"]):
            assert a == [{1: .1, 4: .4}.get(x) for x in k or []]
            assert b == [67 if x == (6, 7) else None for x in zip([None, *(k or [])], k or [])]
    assert sizes == [3, 9, 3]


def test_windows_of_shared_ids_and_of_others_agree(spark, docs):
    """Windows arise in the blocks that look losses up; the arrays of losses go to no second worker."""
    from inkprobe.operators import baselines as bl

    vocab, corpus = tk.vocab_and_corpus(docs, lower=True, with_word=True)
    model = sc.train(corpus, vocab, {"target": F.col("doc_id") % 2 == 0, "reference": F.col("doc_id") % 3 == 0}, store=True)
    alone = bl.window_losses(corpus.filter("doc_id <> 5"), model, 8, 7)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange") and "MapInArrow" not in plan[:plan.index("Exchange")].replace(
        "FlatMapCoGroupsInArrow", "")
    rounded = lambda rows: sorted(str((r["doc_id"], r["begin"], r["n"], r["sequence"], r["words"], [
        None if v is None else round(v, 9) for v in (r["loss"], r["loss_ref"], r["loss_lower"], *r["logp"])])) for r in rows.collect())
    # The same documents under an id that two rows have.
    twice = corpus.filter("doc_id = 5").limit(1).withColumn("input_ids", F.array().cast("array<int>")).withColumn(
        "low_ids", F.col("input_ids")).withColumn("words", F.array().cast("array<string>"))
    one = corpus.filter("doc_id <> 5")
    shared = one.unionByName(twice.withColumn("doc_id", F.lit(7).cast("long")))
    assert rounded(bl.window_losses(shared, model, 8, 7).filter("doc_id = 7")) == rounded(alone.filter("doc_id = 7"))
