import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from inkprobe.llm import decontaminate, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(text, items, m=13):
    words, hit, found = _words(text), set(), set()
    for item, body in items:
        own = _words(body)
        k = min(m, len(own))
        for j in range(len(own) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i:i + k] == own[j:j + k]:
                    hit |= set(range(i, i + k))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


def _bench(spark):
    return spark.createDataFrame([
        (1, "quick brown FOX"), (20, "dog"), (3, None), (4, "!!"), (None, "lazy dog"), (5, "ipsum dolor sit amet lorem"),
        (6, " ".join(f"w{i}" for i in range(30))), (7, "absent words"), (20, "dog")], "item_id bigint, text string")


def test_equals_brute_force(spark, docs):
    bench = _bench(spark)
    items = [tuple(r) for r in bench.collect()]
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([
        (100, "x " + " ".join(f"W{i}" for i in range(5, 25)) + " y"), (101, " ".join(f"w{i}" for i in range(12)))],
        "doc_id bigint, text string"))
    rows = {(r.doc_id, r.text): _brute(r.text[:300] if r.text and len(r.text) > 9_000 else r.text, items)
            for r in extra.collect()}
    got = extra.select("doc_id", "text").alias("d")
    out = decontaminate.search(extra, bench).collect()
    assert len(out) == got.count()
    for r in out:
        want = [v for (i, t), v in rows.items() if i == r.doc_id and not (t and len(t) > 9_000)]
        assert not want or (r.n_words, r.n_hit, r.items) in want
    long = [r for r in out if r.doc_id in (6, 7)]
    assert len(long) == 3 and all(r.n_words == 20_000 and r.items == [5] for r in long)


def test_blocks_of_the_benchmark_give_the_same(spark, docs):
    bench = _bench(spark)
    one = decontaminate.search(docs, bench).select("doc_id", "n_words", "n_hit", F.sort_array("items").alias("items"))
    many = decontaminate.search(docs, bench, block_words=10).select(
        "doc_id", "n_words", "n_hit", F.sort_array("items").alias("items"))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_long_items_are_cut_without_losing_windows(spark):
    body = " ".join(f"t{i}" for i in range(2_500))
    bench = spark.createDataFrame([(1, body)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, body)], "doc_id bigint, text string")
    assert decontaminate.search(docs, bench, block_words=600).first()["n_hit"] == 2_500


def test_drop_keeps_clean_rows_and_columns(spark, docs, no_docs):
    out = decontaminate.drop_contaminated(docs, _bench(spark))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 3, 4, 5, 9, 11]
    assert decontaminate.drop_contaminated(docs, _bench(spark).limit(0)).count() == docs.count()
    assert decontaminate.search(no_docs, _bench(spark)).count() == 0


def test_digest(spark):
    got = spark.createDataFrame([([10, 9, 100],)], "items array<bigint>").select(decontaminate.items_digest()).first()[0]
    assert got == hashlib.sha256(b"10,100,9").hexdigest()


# ------------------------------------------------------------------ licences

def test_every_template_is_found_in_prose(spark):
    rows = [(i, f"Some words before it. {t}\nAnd other words follow here.") for i, (_, t) in
            enumerate(sorted(licenses.TEMPLATES.items()))]
    names = sorted(licenses.TEMPLATES)
    got = licenses.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for r in got:
        own = [m for m in r.matches if m.license == names[r.doc_id]]
        assert own and own[0].coverage == 1.0, names[r.doc_id]
        text = rows[r.doc_id][1]
        assert text[own[0].start:own[0].end].split()[0].strip('"(') == licenses.TEMPLATES[names[r.doc_id]].split()[0].strip('"(')


def test_changed_words_lower_the_coverage_and_repeats_count(spark):
    text = "Licensed under the Apache License, Version 2.0."
    edited = licenses.TEMPLATES["MIT"].replace("merge,", "combine,").replace("free of charge", "free of all charge")
    got = {r.doc_id: r.matches for r in licenses.find(spark.createDataFrame(
        [(1, f"{text} x {text}"), (2, edited), (3, "Licensed under something else entirely")],
        "doc_id bigint, text string")).collect()}
    assert [m.license for m in got[1]] == ["Apache-2.0-notice"] * 2
    assert [m.license for m in got[2]] == ["MIT"] and 0.95 < got[2][0].coverage < 1
    assert got[3] == []


def test_licences_of_odd_rows(docs, no_docs):
    got = licenses.find(docs).collect()
    assert len(got) == 12 and all(r.matches == [] for r in got)
    assert licenses.find(no_docs).count() == 0
    short = licenses.find(docs, templates={"two": "lazy dog", "none": "!!"}).filter("size(matches) > 0")
    assert sorted(r.doc_id for r in short.collect()) == [1, 2, 10]


def test_winnowing_keeps_the_last_least_of_each_window():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 50):
        hashes = rng.integers(0, 9, n).astype(np.uint64)
        w = min(licenses.WINNOW, n)
        want = sorted({max(range(i, i + w), key=lambda j: (-int(hashes[j]), j)) for i in range(n - w + 1)})
        assert licenses.winnow(hashes).tolist() == want


def test_item_ids_keep_their_own_type(spark):
    from pyspark.sql import functions as F

    from inkprobe.llm import decontaminate

    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("mmlu-1", " ".join(words[:14])), ("arc-10", " ".join(words[5:25])), (None, "w1 w2")],
                                  "item_id string, text string")
    for block_words in (10_000, 15):
        got = decontaminate.search(docs, bench, block_words=block_words).withColumn("h", decontaminate.items_digest())
        rows = {r.doc_id: r for r in got.collect()}
        assert sorted(rows[1]["items"]) == ["arc-10", "mmlu-1"] and rows[2]["items"] == []
        import hashlib
        assert rows[1].h == hashlib.sha256(b"arc-10,mmlu-1").hexdigest()
    assert got.schema["items"].dataType.elementType.typeName() == "string"
