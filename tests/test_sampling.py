import hashlib

import pytest

from inkprobe.functions.ordering import hash_rank, running_totals
from inkprobe.operators import sampling as sp


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_hash_rank_is_the_hash_order(spark):
    got = {r["doc_id"]: r["rank"] for r in hash_rank(spark.range(500).withColumnRenamed("id", "doc_id"), "doc_id", 42).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == order(range(500))


def test_sample_and_error(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert {r["doc_id"] for r in sp.sample_n(df, 7).collect()} == set(order(range(50))[:7])
    with pytest.raises(Exception, match="sample larger"):
        sp.sample_n(df, 51).collect()
    assert sp.cap_rows(df, 20, 42).count() == 20 and sp.cap_rows(df, None, 42).count() == 50


def test_chunks(spark):
    rows = [(i, 200 if i % 10 else 50) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    chunks = sp.split_chunks(df.filter("doc_id < 60"), df.filter("doc_id >= 60"), n_chunks=3).collect()
    members = order([i for i, n in rows if n > 100 and i < 60])
    per = 36 // 3
    assert len(chunks) == 2 * 3 * per
    got = {(c["chunk_id"], c["row_in_chunk"]): (c["doc_id"], c["label"]) for c in chunks}
    for k in range(3):
        for j in range(per):
            assert got[(k, j)] == (members[k * per + j], 1)
            assert got[(k, per + j)][1] == 0
    with pytest.raises(Exception, match="smaller"):
        sp.split_chunks(df.filter("doc_id < 60"), df.filter("doc_id >= 60"), n_chunks=3, n_pos=13).collect()


def test_split_and_ids(spark):
    df = spark.range(11).withColumnRenamed("id", "doc_id")
    roles = sp.random_split(df).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in roles} == {"test": 3, "train": 8}
    ids = spark.createDataFrame([(0, 9), (1, 2)], "ordinal int, doc_id bigint")
    assert [r["doc_id"] for r in sp.select_ids(df, ids).collect()] == [9, 2]
    assert [r["doc_id"] for r in sp.first_n(df, 2).collect()] == [0, 1]
    assert sp.id_range(df, 3, 5).count() == 2 and sp.id_list(df, ids).count() == 2


def test_running_totals_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else "g", i * 7 % 101 + i / 1000, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x double, n bigint")
    for down in (False, True):
        got = running_totals(df, "x", ["n"], ["g"], descending=down).collect()
        for g in ("hot", "g"):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=down)
            out = {r["x"]: r for r in got if r["g"] == g}
            cum = 0
            for i, (_, x, n) in enumerate(mine):
                cum += n
                assert out[x]["cum_n"] == cum
                assert out[x]["next_n"] == (mine[i + 1][2] if i + 1 < len(mine) else None)
                assert out[x]["total_n"] == sum(r[2] for r in mine)


def test_dated_chunks_hold_only_documents_between_the_years(spark):
    from inkprobe.operators import sampling as sp

    rows = [(i, 500, str(1840 + i)) for i in range(80)] + [(200, 500, None), (201, 500, "unknown"), (202, 5, "1860")]
    members = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, publication_date string")
    others = spark.createDataFrame([(1_000 + a, b, c) for a, b, c in rows],
                                   "doc_id bigint, n_tokens int, original_publication string")
    got = sp.dated_chunks(members, others, lo=1850, hi=1889, n_chunks=4).collect()
    assert len(got) == 80 and {r["chunk_id"] for r in got} == {0, 1, 2, 3}
    assert all(10 <= r["doc_id"] % 1_000 < 50 and r["label"] == (r["doc_id"] < 1_000) for r in got)
