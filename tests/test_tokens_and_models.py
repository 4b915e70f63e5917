import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkprobe.functions.skew import lookup_join
from inkprobe.operators import baselines as bl
from inkprobe.operators import neighbours as nb
from inkprobe.operators import scoring as sc
from inkprobe.operators import tokens as tk
from inkprobe.streaming import counts as stream

WINDOWS = [  # length, context, stride, context windows, further windows, scored, slots
    (10, 4, 3, [(0, 4), (3, 7), (6, 10)], [(9, 10)], set(range(1, 10)), 9),
    (10, 4, 4, [(0, 4), (4, 8), (8, 10)], [], set(range(1, 10)) - {4, 8}, 7),
    (10, 4, 2, [(0, 4), (2, 6), (4, 8), (6, 10)], [(8, 10)], set(range(1, 10)), 12),
    (255, 128, 127, [(0, 128), (127, 255)], [(254, 255)], set(range(1, 255)), 254),
    (4, 4, 3, [(0, 4)], [(3, 4)], {1, 2, 3}, 3),
    (1, 4, 3, [(0, 1)], [], set(), 0),
    (0, 4, 3, [], [], set(), 0),
]


@pytest.mark.parametrize("n,c,s,windows,more,scored,slots", WINDOWS)
def test_windows(spark, n, c, s, windows, more, scored, slots):
    one = spark.createDataFrame([(1, n)], "doc_id bigint, n_tokens int")
    pairs = lambda df: sorted((r["begin"], r["end"]) for r in df.collect())
    assert pairs(tk.context_windows(one, c, s)) == windows
    assert pairs(tk.sequence_windows(one, c, s)) == sorted(windows + more)
    if n:
        pos = one.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = pos.select("pos", tk.scoring_begin(c, s).alias("b"), tk.slot_count(c, s).alias("k"),
                          tk.total_slots(c, s).alias("t")).collect()
        assert {r["pos"] for r in rows if r["b"] is not None} == scored
        assert sum(r["k"] for r in rows) == slots == rows[0]["t"]
        covered = tk.explode_windows(pos, c, s, early_stop=True).groupBy("begin").count().collect()
        assert sorted((r["begin"], r["begin"] + r["count"]) for r in covered) == windows


def test_resolve_overlaps(spark):
    df = spark.createDataFrame([(1, 3, 0, 1.0), (1, 3, 2, 5.0)], "doc_id int, pos int, begin int, nll double")
    assert sc.resolve_overlaps(df).collect()[0]["nll"] == 5.0


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    return [(i, " ".join(rng.choice(words[: 4 + i % 8]) for _ in range(rng.randint(0, 25))), i % 3 != 0)
            for i in range(25)]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, member boolean")
    vocab = tk.build_vocab(docs, size=11).cache()  # 8 words: the rest is unknown
    tokens = tk.token_table(docs, vocab, ["member"], with_next=True).cache()
    model = sc.train(tokens, vocab, {"target": F.col("member")})
    return docs, vocab, tokens, model


def brute(vocab_ids, tokens, member_only=True):
    docs = defaultdict(dict)
    for r in tokens.collect():
        docs[(r["doc_id"], r["member"])][r["pos"]] = r["token_id"]
    seqs = {k: [v[i] for i in range(len(v))] for k, v in docs.items()}
    uni, pair, ctx = Counter(), Counter(), Counter()
    for (_, m), ids in seqs.items():
        if m:
            for p, t in zip([1, *ids], ids):
                uni[t] += 1
                pair[p, t] += 1
                ctx[p] += 1
    types = set(vocab_ids) | {0}
    total = sum(uni.values()) + len(types)

    def p(prev, t):
        u = (uni[t] + 1) / total
        return u if not ctx[prev] else 0.5 * pair[prev, t] / ctx[prev] + 0.5 * u
    return {k[0]: v for k, v in seqs.items()}, types, p


def test_tokenize_and_vocab(small):
    docs, vocab, tokens, _ = small
    rows = {r["doc_id"]: r for r in tk.tokenize(docs, vocab).collect()}
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(3, 11))
    for i, text, member in corpus():
        assert rows[i]["input_ids"] == [ids.get(w, 0) for w in text.split()]
        assert rows[i]["attention_mask"] == [1] * len(text.split()) and rows[i]["member"] == member
    long = tk.explode_ids(tk.tokenize(docs, vocab)).select("doc_id", "pos", "token_id", "prev")
    assert sorted(long.collect()) == sorted(tokens.select("doc_id", "pos", "token_id", "prev").collect())
    whole = tk.build_vocab(docs, size=None).collect()
    best = sorted(Counter(w for _, t, _ in corpus() for w in t.split()).items(), key=lambda x: (-x[1], x[0]))
    assert [(r["token"], r["n"]) for r in sorted(whole, key=lambda r: r["token_id"])] == best


def test_model_scores_and_top_lists(small):
    _, vocab, tokens, model = small
    seqs, types, p = brute([r["token_id"] for r in vocab.collect()], tokens)
    for r in sc.score_tokens(tokens, model).collect():
        assert math.isclose(r["nll"], -math.log(p(r["prev"], r["token_id"])), rel_tol=1e-12)
    for prev in types | {1}:
        assert math.isclose(sum(p(prev, t) for t in types), 1.0)
    for k in (1, 3, 20):
        for r in sc.top_lists(model, k).collect():
            want = sorted(((-p(r["prev"], t), t) for t in types))[:k]
            assert [t["token_id"] for t in r["top"]] == [t for _, t in want]
    for r in sc.with_max_p(tokens, model).collect():
        assert math.isclose(r["max_p"], max(p(r["prev"], t) for t in types))


def test_general_proba_is_the_mean_distribution(small):
    _, vocab, tokens, model = small
    seqs, types, p = brute([r["token_id"] for r in vocab.collect()], tokens)
    context, stride = 4, 2
    want = defaultdict(float)
    docs = 0
    for ids in seqs.values():
        slots = []
        for b in range(0, len(ids), stride):
            end = min(b + context, len(ids))
            slots += [ids[i - 1] for i in range(b + 1, end)]
            if end == len(ids):
                break
        if slots:
            docs += 1
            for t in types:
                want[t] += sum(p(c, t) for c in slots) / len(slots)
    weights = sc.doc_general_proba(tokens.withColumn("chunk_id", F.lit(0)), ["chunk_id"], context, stride)
    got = {r["token_id"]: r["value"] for r in sc.general_proba(weights, model).collect()}
    assert set(got) == types
    for t in types:
        assert math.isclose(got[t], want[t] / docs, rel_tol=1e-9)


def test_neighbourhood_matches_full_scoring(small):
    _, vocab, tokens, model = small
    seqs, types, p = brute([r["token_id"] for r in vocab.collect()], tokens)
    masked = sc.train(tokens, vocab, {"target": F.col("member")}, ctx=("prev", "next"))
    pos = nb.swap_positions(tokens, 5, 4)
    cands = nb.candidates(pos, nb.triple_options(pos, masked, model, k=3)).cache()
    tops = nb.top_neighbors(cands, 6).cache()
    scores = {(r["doc_id"], r["begin"]): r["neighborhood_score"] for r in nb.neighborhood_score(tops, model).collect()}
    swaps = defaultdict(list)
    for r in tops.collect():
        swaps[r["doc_id"], r["begin"]].append((r["pos"] - r["begin"], r["cand_id"]))
    assert swaps and set(swaps) == set(scores)
    mean = lambda ids: sum(math.log(p(a, b)) for a, b in zip(ids, ids[1:])) / (len(ids) - 1)
    for (doc, begin), all_swaps in swaps.items():
        ids = seqs[doc][begin:begin + 5]
        others = [mean([c if i == at else x for i, x in enumerate(ids)]) for at, c in all_swaps]
        assert math.isclose(scores[doc, begin], mean(ids) - sum(others) / len(others), abs_tol=1e-9)


def test_lookup_join_with_hot_keys(spark):
    left = spark.createDataFrame([(i, 0 if i % 3 else i % 7, i % 2) for i in range(300)], "id int, a int, b int")
    right = spark.createDataFrame([(a, b, 1000 if a == 0 else 1, a * 10 + b) for a in range(6) for b in range(2)],
                                  "a int, b int, n int, v int")
    got = sorted(lookup_join(left, right, ["a", "b"], ["v"], ["id"], slots=4).collect())
    assert got == sorted(left.join(right.drop("n"), ["a", "b"], "left").select("id", "a", "b", "v").collect())


def test_lookup_join_settles_hot_keys_that_the_right_side_lacks(spark):
    """Rows without a match or a key spread over the shuffle like those of hot keys."""
    left = spark.range(3_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS a")
    right = spark.range(0, 3_000, 5).selectExpr("id AS a", "id * 2 AS v").filter("a <> 7")
    got = lookup_join(left, right, ["a"], ["v"], ["id"], slots=10)
    want = left.join(right, "a", "left").select("id", "a", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _sorted_joins(df):
    """Keys of the sort-merge joins in the plan, without adaptive execution's choices."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "SortMergeJoin" in line]


def test_no_plain_join_on_hot_tokens_beyond_the_broadcast_bound(spark, small, monkeypatch):
    """With a vocabulary too large to broadcast, every join of scoring and norms scatters what is hot."""
    from inkprobe import params
    from inkprobe.operators import normalise as nm

    docs, vocab, tokens, model = small
    want = sorted(map(str, sc.score_tokens(tokens, model, max_p=True).collect()))
    norms = spark.range(12).selectExpr("0 AS fold", "cast(id AS int) AS token_id", "(id + 1) / 100.0D AS value")
    scored = sc.score_tokens(tokens, model)
    want_norms = sorted(map(str, nm.norm_arrays(scored, norms, 1).collect()))
    plain_tokens = sorted(map(str, tk.token_table(docs, vocab, with_next=True, lower=True).collect()))
    lists = sorted(map(str, sc.with_top_probs(tokens, model).collect()))
    mass = sorted((r["token_id"], round(r["value"], 12)) for r in sc.general_proba(
        sc.doc_general_proba(tokens.withColumn("chunk_id", F.lit(0)), ["chunk_id"]), model).collect())

    monkeypatch.setattr(params, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(params, "MAX_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        far = sc.score_tokens(tokens, model, max_p=True)
        assert sorted(map(str, far.collect())) == want
        # The one shuffle of all tokens goes by the scattered first key and by the whole pair.
        joins = _sorted_joins(far)
        assert joins and all("_k0" in j for j in joins), joins
        norm_rows = nm.norm_arrays(sc.score_tokens(tokens, model), norms, 1)
        assert sorted(map(str, norm_rows.collect())) == want_norms
        assert all("_k0" in j for j in _sorted_joins(norm_rows))
        table = tk.token_table(docs, vocab, with_next=True, lower=True)
        assert sorted(map(str, table.collect())) == plain_tokens
        assert all("_k0" in j for j in _sorted_joins(table))
        assert sorted(map(str, sc.with_top_probs(tokens, model).collect())) == lists
        assert sorted((r["token_id"], round(r["value"], 12)) for r in sc.general_proba(
            sc.doc_general_proba(tokens.withColumn("chunk_id", F.lit(0)), ["chunk_id"]), model).collect()) == mass
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_min_k(spark):
    logp = [-.1, -3., -.5, -2., -1., -4., -.2, -.3, -1.5, -2.5]
    df = spark.createDataFrame([(sorted(logp),)], "l array<double>")
    row = df.select(*[bl.min_k(F.col("l"), r).alias(bl.min_k_name(r)) for r in (0.05, .1, .2, .3, .4, .5, .6)]).first()
    want = [None, 4, 3.5, 3.1666666667, 2.875, 2.6, 2.3333333333]
    assert [None if v is None else round(v, 10) for v in row] == want


def test_zlib_length(spark):
    import zlib
    texts = ["the cat sat on the mat", "", "é" * 50, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bl.zlib_len("t")).collect()]
    assert got == [None if t is None else len(zlib.compress(t.encode())) for t in texts]


def test_counts_merge_and_stream(spark, tmp_path, small):
    docs, vocab, tokens, _ = small
    whole = {r["token_id"]: r["n"] for r in tk.token_counts(tokens).collect()}
    halves = [tk.token_counts(tokens.filter(f"doc_id % 2 = {i}")) for i in (0, 1)]
    assert {r["token_id"]: r["n"] for r in tk.merge_counts(*halves).collect()} == whole
    assert math.isclose(sum(r["value"] for r in tk.token_freq(tk.token_counts(tokens)).collect()), 1.0)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        src = stream.read_documents(spark, str(tmp_path / "in"), "doc_id bigint, text string")
        stream.count_into(src, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["token"]: r["n"] for r in stream.merged(spark, str(tmp_path / "out")).collect()}
    assert got == dict(Counter(w for _, t, _ in corpus() for w in t.split()))


def test_streamed_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    import shutil

    docs = spark.createDataFrame([(i, f"a b{i % 3} a") for i in range(20)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "made").glob("*.parquet")), tmp_path / "one/documents.parquet")
    for folder in ("many", "one"):
        docs.limit(1).write.mode("overwrite").parquet(str(tmp_path / folder / "labels.parquet"))  # not asked for
        src = stream.read_documents(spark, str(tmp_path / folder), "doc_id bigint, text string", "documents.parquet")
        stream.count_into(src, str(tmp_path / f"out_{folder}"), str(tmp_path / f"state_{folder}")).awaitTermination()
        got = {r["token"]: r["n"] for r in stream.merged(spark, str(tmp_path / f"out_{folder}")).collect()}
        assert got == {"a": 40, "b0": 7, "b1": 7, "b2": 6}


def test_score_intake(spark):
    df = spark.createDataFrame([(1, 2, 3, 0.5, "x")], "doc_id int, pos int, token_id int, nll float, extra string")
    assert sc.from_token_scores(df).columns == ["doc_id", "pos", "token_id", "nll", "top", "extra"]
    with pytest.raises(ValueError, match="nll"):
        sc.from_token_scores(df.drop("nll"))


@pytest.mark.parametrize("first_depth", [1, 3, 32])
def test_bridge_lists_equal_the_whole_product(spark, small, first_depth):
    """The k best tokens between two, against p(t | prev) p(next | t) of every token of the vocabulary."""
    _, vocab, tokens, model = small
    _, types, p = brute([r["token_id"] for r in vocab.collect()], tokens)
    asked = [(a, b) for a in [*types, 1, 500] for b in types]
    table = spark.createDataFrame(asked, "prev int, next int")
    for k in (1, 4):
        got = {(r["prev"], r["next"]): r["top"] for r in nb.bridge_lists(table, model, k, first_depth).collect()}
        assert len(got) == len(asked)
        for (a, b), top in got.items():
            every = {t: p(a, t) * p(t, b) for t in types}
            assert [x["p"] for x in top] == pytest.approx(sorted(every.values(), reverse=True)[:k], rel=1e-12)
            assert all(every[x["token_id"]] == pytest.approx(x["p"], rel=1e-12) for x in top)
            assert len({x["token_id"] for x in top}) == k


def test_unseen_contexts_take_bridged_candidates(small):
    _, vocab, tokens, model = small
    masked = sc.train(tokens, vocab, {"target": F.col("member")}, ctx=("prev", "next"))
    positions = nb.swap_positions(tokens)
    shares = {r["seen"]: r for r in nb.context_shares(positions, masked).collect()}
    asked = positions.groupBy("prev", "next").count()
    assert sum(r["positions"] for r in shares.values()) == positions.count()
    assert sum(r["contexts"] for r in shares.values()) == asked.count() and shares[False]["contexts"] > 0
    seen = {(r["prev"], r["next"]) for r in masked.contexts.collect()}
    plain, bridged = ({(r["prev"], r["token_id"], r["next"]): r["options"] for r in nb.triple_options(
        positions, masked, model, 4, bridge=b).collect()} for b in (None, model))
    tops = {(r["prev"], r["next"]): [t["token_id"] for t in r["top"]] for r in nb.bridge_lists(
        asked.select("prev", "next").filter("next <> 2"), model, 4).collect()}
    assert plain.keys() == bridged.keys()
    for (a, t, b), options in bridged.items():
        if (a, b) in seen or b == 2:
            assert options == plain[a, t, b]
        else:
            assert [o["token_id"] for o in options] == [x for x in tops[a, b] if x != t]
