import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprobe.llm import queries, sentencepieces, shards, tokens_file

ODD = ["", " ", "  ", "a  b", " a", "a ", "▁x▁▁y", "日本語 テスト 🙂🙂", "\t\n x", "é" * 50, "a" * 300, "\x00z",
       "<s> </s> <unk> <0x41>", "a \n b", "x  y z", "q　w e", "<|endoftext|> x"]


# ------------------------------------------------------------ SentencePiece

@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.load(queries.PIECES)


@pytest.fixture(scope="module")
def library(pieces):
    """The library's own unigram coder, given the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(queries.PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = float(pieces.scores[i])
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_encoding_equals_the_library(pieces, library, small_docs):
    coder = sentencepieces.Coder(pieces)
    texts = ODD + [r.text for r in small_docs.collect()]
    equal = 0
    for t, ids in zip(texts, coder.encode(texts)):
        want = library.encode(t)
        equal += want == ids.tolist()
        # Where the order of equal pieces differs, the sums must not.
        assert abs(pieces.scores[want].sum() - pieces.scores[ids].sum()) < 1e-2, t[:80]
        assert coder.decode(ids) == library.decode(ids.tolist())
        assert coder.decode(ids) == t.replace("▁", " ")
    assert equal >= 0.95 * len(texts)


def test_viterbi_equals_exhaustive_search(pieces):
    names = {t: i for i, t in enumerate(pieces.texts) if t}

    def best(data):
        if not data:
            return 0.0
        return max((pieces.scores[names[data[:n]]] + best(data[n:]) for n in range(1, len(data) + 1)
                    if data[:n] in names and names[data[:n]] >= 259), default=-1e9)

    for word in ("▁the", "▁house", "▁reading", "▁inter"):
        ids = sentencepieces.viterbi([word.encode()], pieces)[0]
        assert abs(pieces.scores[ids].sum() - best(word.encode())) < 1e-6


def test_double_array_holds_its_keys():
    keys = [(b"a", 0), (b"ab", 1), (b"abc", 2), (b"\xff\xfe", 3), (b"b", 4)]
    base, check, value = sentencepieces.double_array(keys)

    def look(key):
        s = 0
        for b in key:
            t = base[s] + b + 1
            if t >= len(check) or check[t] != s:
                return -1
            s = t
        return value[s]

    assert [look(k) for k, _ in keys] == [0, 1, 2, 3, 4]
    assert look(b"ac") == look(b"\xff") == look(b"c") == -1


def test_pieces_of_odd_rows(docs, no_docs):
    got = sentencepieces.encode_and_decode(docs, queries.PIECES).collect()
    assert len(got) == 12 and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_pieces for r in got}[3] == 0
    assert sentencepieces.encode_and_decode(no_docs, queries.PIECES).count() == 0
    coded = sentencepieces.encode(docs, queries.PIECES)
    back = {r.doc_id: r.text for r in sentencepieces.decode(coded, queries.PIECES).collect()}
    assert back[11] == "Größe und Länge,   sowie 日本 🙂" and back[3] == ""


def test_unknown_scores_are_refused():
    with pytest.raises(ValueError):
        sentencepieces.load(queries.PIECES, "none")


# ---------------------------------------------------------------- token files

@pytest.mark.parametrize("values", [
    [0], [5] * 10, [7, 7, 4_000_000_000, 7], list(range(1_000)), [0, 2**32 - 1], [1] * 95 + [1 << 20] * 5])
def test_block_round_trip(values):
    ids = np.array(values, np.uint32)
    assert (tokens_file.decode_block(tokens_file.encode_block(ids)) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(1_000, dtype=np.uint32) % 16
    plain = len(tokens_file.encode_block(ids))
    ids[::100] = 1 << 30
    assert len(tokens_file.encode_block(ids)) == plain + 10 * 8


def test_file_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    documents = [rng.integers(0, 60_000, n).astype(np.uint32) for n in (0, 1, 9_000, 3, 0, 20_000, 5)]
    held = io.BytesIO()
    writer = tokens_file.FileWriter(held)
    for ids in documents:
        writer.document(ids)
    writer.close()
    assert all((a == b).all() for a, b in zip(tokens_file.read_documents(held), documents, strict=True))
    for i, ids in enumerate(documents):
        assert (tokens_file.read_document(held, i) == ids).all()


def test_parts_give_the_ids_of_whole_texts(small_docs):
    coder = tokens_file.Encoder(open(queries.BYTE_BPE, "rb").read())
    texts = ODD + [r.text for r in small_docs.collect()]
    for part, whole in zip(coder.encode(texts), coder.whole(texts), strict=True):
        assert part.tolist() == whole.tolist()


def test_ids_on_spark_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    coder = tokens_file.Encoder(open(queries.BYTE_BPE, "rb").read())
    start = 0
    want = {}
    for k in sorted(docs):
        ids = np.append(coder.whole([docs[k]])[0], np.uint32(2))
        want[k] = (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_ids(spark, folder).collect()}
    assert got == want


def test_ids_of_odd_rows(docs, no_docs):
    got = tokens_file.read(tokens_file.write(docs, queries.BYTE_BPE)).collect()
    assert len(got) == 12
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    keys = [r.doc_id for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert {r.doc_id: r.n_tokens for r in got}[3] == 1
    assert tokens_file.read(tokens_file.write(no_docs, queries.BYTE_BPE)).count() == 0


def test_ids_with_keys_of_any_type(spark, docs):
    named = docs.selectExpr("concat('mmlu-', doc_id) AS `the key`", "text")
    got = tokens_file.read(tokens_file.write(named, queries.BYTE_BPE, "the key"), "the key").collect()
    assert len(got) == 12 and "mmlu-10" in {r["the key"] for r in got}
    empty = named.limit(0)
    assert tokens_file.read(tokens_file.write(empty, queries.BYTE_BPE, "the key"), "the key").columns[0] == "the key"


def test_encoder_forgets_and_learns_again(monkeypatch, small_docs):
    monkeypatch.setattr(tokens_file, "MEMO_PARTS", 50)
    coder = tokens_file.Encoder(open(queries.BYTE_BPE, "rb").read())
    texts = ODD + [r.text for r in small_docs.limit(20).collect()]
    for _ in range(3):
        for i in range(0, len(texts), 7):
            some = [t or "" for t in texts[i:i + 7]]
            assert [e.tolist() for e in coder.encode(some)] == [e.tolist() for e in coder.whole(some)]
    assert coder.encode([]) == []


def test_pieces_are_cut_by_their_text():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c" * 4, "d" * 4])], names=["key", "text"])
    cut = [p.column(0).to_pylist() for p in tokens_file.pieces([batch, batch.slice(0, 0)], 20)]
    assert sum(cut, []) == list(range(6)) and cut == [[0, 1, 2], [3, 4, 5]]


# -------------------------------------------------------------------- shards

def test_shards_are_gapless_and_even(spark, small_docs):
    for bucket_bytes in (1 << 24, 20_000):
        got = shards.shard(small_docs, 8, bucket_bytes=bucket_bytes).collect()
        assert sorted(r.rec.doc_id for r in got) == sorted(r.doc_id for r in small_docs.collect())
        by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
        assert all(slots == list(range(len(slots))) for slots in by.values())
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_order_is_random_and_repeatable(small_docs):
    def order(seed):
        rows = shards.shard(small_docs, 1, seed=seed, bucket_bytes=50_000).collect()
        return [r.rec.doc_id for r in sorted(rows, key=lambda r: r.slot)]

    one, again, other = order(1), order(1), order(2)
    assert one == again and one != other and one != sorted(one)
    assert abs(np.corrcoef(one, np.arange(len(one)))[0, 1]) < 0.3


def test_shards_of_odd_rows(spark, docs, no_docs, tmp_path):
    got = shards.shard(docs, 8)
    rows = got.select("rec.*", "shard", "slot", shards.text_size("rec.text").alias("s"),
                      shards.text_crc32("rec.text").alias("c")).collect()
    assert len(rows) == 12 and {(r.s, r.c) for r in rows if r.doc_id == 3} == {(1, 0)}
    assert {r.c for r in rows if r.doc_id == 11} == {zlib.crc32("Größe und Länge, ▁ sowie 日本 🙂".encode())}
    assert shards.shard(no_docs, 8).count() == 0
    shards.write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 12 and back.filter(F.col("_shard") == 0).count() == 2
