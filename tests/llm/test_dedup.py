import hashlib
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from inkprobe.llm import components, exact_dedup, simhash, skewed


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_marks_equal_the_definition(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[_norm(r.text)].append(r.doc_id)
    got = exact_dedup.mark_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (least, len(ids))
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)  # of the repeated row 7 none, of texts 6 and 7 one


def test_drop_keeps_one_row_of_each_text_with_all_columns(docs):
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 1, 3, 5, 6, 9, 10, 11]


def test_empty_table(no_docs):
    assert exact_dedup.mark_duplicates(no_docs).count() == 0
    assert exact_dedup.drop_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_only_repeated_hashes_pass_the_filter(spark):
    keys = spark.range(5_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    twice = keys.unionByName(keys.limit(50))
    n_bitmaps = exact_dedup.filter_size(5_050)
    cells = exact_dedup.repeated_cells(twice, "digest", n_bitmaps)
    tested = exact_dedup.maybe_repeated(twice, "digest", cells, n_bitmaps)
    maybe = tested.filter("_maybe")
    assert maybe.groupBy("digest").count().filter("count > 1").count() == 50  # none is missed
    assert maybe.count() < 100 + 250  # few others


def test_a_filter_too_large_to_broadcast_gives_the_same_with_two_scans(spark, docs, monkeypatch, tmp_path):
    """Beyond the broadcast bound bitmaps meet rows in a shuffle; texts are still scanned twice."""
    from inkprobe import params

    copies = docs.unionByName(docs.filter("doc_id = 6").crossJoin(spark.range(40)).drop("id"))
    copies.write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    whole = sorted(map(str, exact_dedup.mark_duplicates(table).collect()))
    monkeypatch.setattr(params, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "filter_size", lambda n: 7)
    assert sorted(map(str, exact_dedup.mark_duplicates(table).collect())) == whole
    scans = []
    stored = exact_dedup.materialize

    def counted(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("text#"))
        return stored(df, name)

    monkeypatch.setattr(exact_dedup, "materialize", counted)
    out = exact_dedup.drop_duplicates(table)
    assert out.count() == 8
    # One stage table reads texts (their digests); the result reads them once for either kind of row.
    assert sum(n > 0 for n in scans) == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(str(tmp_path / "docs")) + plan.count("Relation [doc_id") <= 2


def test_hot_group_join(spark):
    rows = spark.range(1_000).selectExpr("id", "if(id % 3 = 0, 0, id) AS g")
    groups = rows.groupBy("g").agg(F.count("*").alias("w"), F.min("id").alias("least"))
    got = skewed.join_groups(rows, groups, "g", "w", slots=10)
    assert got.count() == 1_000
    assert got.filter("g = 0").agg(F.sum("least"), F.count("*")).first()[:] == (0, 334)


def _brute_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition(docs, small_docs):
    for table in (docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), small_docs):
        want = {r.doc_id: _brute_fingerprint(r.text) for r in table.select("doc_id", "text").collect()}
        got = {r.doc_id: int(r.h, 16) for r in simhash.fingerprints(table).select(
            "doc_id", simhash.hex16(F.col("fp")).alias("h")).collect()}
        assert got == want


def test_fingerprint_hash_is_also_sparks(spark):
    text = "one two three"
    h = spark.sql(f"SELECT xxhash64('{text}') AS h").first().h
    assert simhash.fingerprint(text.encode()) == h % (1 << 64)


def _brute_components(fps, radius):
    """Smallest key reachable over links, from {key: fingerprint}."""
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_links_and_components_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(90):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            f ^= 1 << b
        fps.append(f)
    fps = list(dict.fromkeys(fps + [0, 1 << 63, (1 << 63) | 3]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    for radius in (0, 2):
        got = dict(components.components(simhash.links(table, radius)).collect())
        want = _brute_components(dict(zip(signed, fps)), radius)
        assert {f: got.get(f, f) for f in signed} == want


def test_component_of_documents_equals_brute_force(small_docs):
    fps = {r.doc_id: _brute_fingerprint(r.text) for r in small_docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(small_docs).collect()}
    assert got == _brute_components(fps, 2)


def test_texts_without_words_link_and_repeated_rows_stay(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 12
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1) for r in kept if r.doc_id in (3, 4, 5, 6, 7)) == [3, 6]
    assert any(r.doc_id is None for r in kept)


def test_rows_of_one_key_go_by_their_own_text(spark):
    """One document of each group stays: the copy of 3 goes, though its key heads a group of its own."""
    a, b = "one text of its own here", "another text with other words in it"
    rows = spark.createDataFrame([(3, b), (7, a), (7, b)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.drop_near_duplicates(rows).collect()) == [(3, b), (7, a)]


def test_chain_settles(spark):
    chain = spark.range(1, 200).selectExpr("id AS hi", "id - 1 AS lo")
    got = components.components(chain)
    assert got.count() == 199 and got.agg(F.max("root")).first()[0] == 0


def test_odd_radius_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), 3)


def test_one_row_of_each_component_stays_also_without_keys(spark):
    text = " ".join(f"word{i}" for i in range(200))
    near = text + " word200"
    rows = [(None, text, "a"), (None, near, "b"), (3, text, "c"), (3, "another thing altogether", "d"), (2, text, "e"),
            (None, "no key at all here", "f"), (None, "no key at all here", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a b` string").repartition(3)
    fps = {r.fp for r in simhash.fingerprints(docs.filter("`a b` IN ('a', 'b')")).collect()}
    linked = bin(min(fps) ^ max(fps)).count("1") <= 2
    kept = sorted(r["a b"] for r in simhash.drop_near_duplicates(docs).collect())
    assert [k for k in kept if k not in "fg"] == (["d", "e"] if linked else ["b", "d", "e"])
    assert sum(k in "fg" for k in kept) == 1
    names = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert (2, 2) in names and (3, 2) in names and (None, 2) in names and (None, None) in names
