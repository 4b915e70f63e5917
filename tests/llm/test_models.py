import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprobe.llm import language, queries, toxicity


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_presence_is_that_of_the_texts():
    texts = ["Abc abc", "", "zzzz"]
    lut = language._alphabet(["abc z"])
    tables = [np.arange(language.ALPHABET ** n, dtype=np.int32) for n in (1, 2)]
    held, owner, sizes = language.presence(texts, lut, [tables[0], tables[1] + language.ALPHABET],
                                           language.ALPHABET + language.ALPHABET ** 2)
    for i, t in enumerate(texts):
        low = t.lower()
        want = len(set(low)) + len({low[j:j + 2] for j in range(len(low) - 1)})
        assert held[owner == i].sum() == want
    assert sizes.tolist() == [7, 0, 4]


def test_kernel_is_the_normalised_count_of_shared_grams():
    model = language.fit([("x", "abab"), ("y", "bcbc")])
    held, _, _ = language.presence(["abab"], model.alphabet, model.tables, len(model.landmarks))
    got = language._kernel(held, model.landmarks, model.sizes)[0]

    def grams(t):
        return {t[i:i + n] for n in range(1, 4) for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))

    want = {kernel("abab", "abab"), kernel("abab", "bcbc")}
    assert np.allclose(sorted(got), sorted(want))


def test_held_out_languages(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language(spark, middle).join(docs, "doc_id")
    held = got.filter("held_out")
    assert got.count() == docs.count()
    assert held.filter("lang_pred = lang").count() >= 0.98 * held.count()
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_languages_of_odd_rows(spark, docs, no_docs):
    model = language.train(docs)
    assert model.languages == ["de", "en", "la"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[3] == got[4] == got[5] == got[9] == ("und", 0.0)
    assert got[7][0] == "la" and got[None][0] in model.languages
    assert language.identify(docs, model).count() == 12
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 8
    assert language.train(no_docs) is None
    assert set(language.identify(docs, None).select("lang_pred").distinct().collect()[0]) == {"und"}
    assert language.identify(no_docs, model).count() == 0


def test_a_very_long_text_is_the_mean_of_its_windows():
    model = language.fit([("x", "abab cdcd " * 20), ("y", "xyxy zuzu " * 20)])
    long = "abab cdcd " * 60_000
    name, score = language.predict([long], model)
    short = language.predict(["abab cdcd " * 1_000], model)
    assert name == ["x"] and abs(score[0] - short[1][0]) < 0.02


# ------------------------------------------------------------------ toxicity

def test_pooling_equals_plain_convolution():
    rng = np.random.default_rng(0)
    net = toxicity.fit([toxicity.hashed(b"a b c"), toxicity.hashed(b"d e")], np.array([1.0, 0.0]), epochs=1)
    text = toxicity.hashed(b"one two three four five")
    rows = toxicity.rows_of(text)
    vectors = np.concatenate([t[r] for t, r in zip(net.tables, rows)], axis=1) + 0
    features = []
    for w, b in zip(net.filters, net.bias):
        padded = np.vstack([vectors, np.zeros((len(w) - 1, vectors.shape[1]))])
        value = np.array([sum(padded[i + j] @ w[j] for j in range(len(w))) for i in range(len(text))]) + b
        features.append(np.maximum(value.max(axis=0), 0))
    want = np.concatenate(features) @ net.out + net.out_bias
    assert np.allclose(toxicity.logits(net, [text])[0], want, atol=1e-4)
    assert rng is not None


def test_long_texts_are_pooled_whole(monkeypatch):
    net = toxicity.fit([toxicity.hashed(b"bad bad words"), toxicity.hashed(b"fine day")], np.array([1.0, 0.0]), epochs=3)
    text = toxicity.hashed(b"fine day " * 300 + b"bad bad words " + b"fine day " * 300)
    whole = toxicity.logits(net, [text])[0]
    monkeypatch.setattr(toxicity, "STEP_WORDS", 50)
    assert np.isclose(toxicity.logits(net, [text])[0], whole, atol=1e-5)


def test_cut_lies_between_the_classes():
    z, y = np.array([-3.0, -1.0, 4.0, 6.0]), np.array([0.0, 0.0, 1.0, 1.0])
    assert toxicity._best_cut(z, y) == 1.5


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op8_toxicity(spark, folder)
    marked = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in marked.groupBy("toxic", "predicted").count().collect()}
    assert got.count() == docs.count()
    assert counts.get((1, 1), 0) >= 0.85 * (counts.get((1, 1), 0) + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.03 * (counts.get((0, 1), 0) + counts.get((0, 0), 0))


def test_toxicity_of_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (10, 0), (11, 0), (6, 0), (None, 1), (9, None)], "doc_id bigint, toxic int")
    net = toxicity.train(docs, labels, None)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net, None).collect()}
    assert toxicity.score(docs, net, None).count() == 12
    assert got[3] == got[4] == got[5] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.train(docs, labels.filter("toxic = 0"), None) is None
    assert toxicity.score(docs, None, None).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(no_docs, net, None).count() == 0


def test_folds_follow_the_checksum_of_the_key(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", queries._fold(5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_number_signs_are_no_letters(spark):
    assert not any(map(language.has_letter, (None, "", "½ ²", "Ⅷ ① 12", "__ 3_4")))
    assert language.has_letter("½ x") and language.has_letter("日") and language.has_letter("3é")
    rows = spark.createDataFrame([(1, "plain words here", "en"), (2, "½ ²", "en"), (3, "autres mots", "fr")],
                                 "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(rows, language.train(rows)).collect()}
    assert got[2] == "und" and got[1] == "en" and got[3] == "fr"


def test_without_labels_the_language_stage_keeps_documents_with_letters(spark):
    rows = spark.createDataFrame([(1, "some text", None), (2, "½ 12 !", None), (3, None, None), (4, "日本", None)],
                                 "doc_id bigint, text string, lang string")
    model = language.train(rows)
    assert model is None
    assert sorted(r.doc_id for r in language.keep_identified(rows, model).collect()) == [1, 4]


def test_sample_takes_each_key_once_and_the_smallest_hashes(spark):
    from inkprobe.llm.samples import per_class

    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 0, id) AS key", "if(id % 100 = 0, 'rare', 'often') AS label")
    got = per_class(rows, "key", "label", 50, 1).collect()
    assert len(got) == len(set(got)) == 100
    place = F.xxhash64(F.lit(1), "key")
    want = {r.key for r in rows.filter("label = 'often'").distinct().orderBy(place).limit(50).collect()}
    assert {r.key for r in got if r.label == "often"} == want


def test_long_labelled_texts_are_learned_from_in_windows(spark):
    rows = np.arange(4 * 30_000, dtype=np.uint32).reshape(-1, 4)
    cut = toxicity.windowed(rows)
    assert len(cut) == toxicity.MOST_WORDS and (cut[0] == rows[0]).all() and (cut[-1] == rows[-1]).all()
    assert toxicity.windowed(rows[:2_000]) is not None and len(toxicity.windowed(rows[:2_000])) == 2_000
    # Every labelled text is long, and one key is repeated.
    texts = [(i, " ".join(["vile", "wicked", "nasty"][(i + j) % 3] if i % 2 and j % 3 == 0 else f"plain{(i * j) % 50}"
                          for j in range(2_600))) for i in range(24)]
    docs = spark.createDataFrame(texts + texts[:1] * 30, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id bigint, toxic int")
    net = toxicity.train(docs, labels, None)
    assert net is not None
    got = {r.doc_id: r.score for r in toxicity.score(docs, net, None).collect()}
    assert min(got[i] for i in range(1, 24, 2)) > max(got[i] for i in range(0, 24, 2))


def test_toxicity_learns_from_rows_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKET_ROWS", 64)
    bad = [f"vile{c * 3}" for c in "abcdefgh"]
    rows = [(i, " ".join([f"plain{(i * j) % 40}" for j in range(1, 12)] + ([bad[i // 2 % 8]] if i % 2 else []))) for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(640)], "doc_id bigint, toxic int")
    net = toxicity.train(docs, labels, None, most=3)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net, None).collect()}
    found = {w: sum(got[i] >= 0.5 for i in range(1, 640, 2) if bad[i // 2 % 8] == w) for w in bad}
    assert all(n == 40 for n in found.values()), found
    again = toxicity.train(docs.repartition(7), labels, None, most=3)
    assert all((a == b).all() for a, b in zip(net.tables, again.tables)) and net.cuts == again.cuts


def test_cuts_of_counted_rows_err_least_between_scores():
    rng = np.random.default_rng(5)
    z = np.rint(rng.normal(0, 2, 400) * 4) / 4
    y = (z + rng.normal(0, 1, 400) > 0).astype(float)
    at, place = np.unique(z, return_inverse=True)
    cut = toxicity._best_cut(at, np.bincount(place, y), np.bincount(place).astype(float))
    error = lambda c: (y * (z < c)).sum() / y.sum() + ((1 - y) * (z >= c)).sum() / (1 - y).sum()
    assert cut not in at and np.isclose(error(cut), min(error(c) for c in [*at, at[-1] + 1]))
    apart = rng.permutation(400) / 7.0
    assert toxicity._best_cut(apart, y) == toxicity._best_cut(apart, y, np.ones(400))


def test_long_texts_keep_the_words_that_win(monkeypatch):
    net = toxicity.fit([toxicity.hashed(b"bad bad words"), toxicity.hashed(b"fine day")], np.array([1.0, 0.0]), epochs=3)
    text = toxicity.hashed(b"fine day " * 300 + b"bad bad words " + b"fine day " * 300)
    monkeypatch.setattr(toxicity, "STEP_WORDS", 50)
    held = toxicity.near_winners(net, text)
    assert len(held) <= 3 * toxicity.FILTERS * len(toxicity.WIDTHS)
    # Seams may form word windows of their own, so the logit is only near.
    assert np.isclose(toxicity.logits(net, [held])[0], toxicity.logits(net, [text])[0], atol=0.02)
    assert {tuple(w) for w in toxicity.hashed(b"bad bad words")} <= {tuple(w) for w in held}
