"""Unigram encoding and decoding with the pieces of a SentencePiece model file.

Encoding finds the piece sequence with the highest sum of log scores (Viterbi)
over a double-array trie of all pieces. Characters that no piece covers become
byte pieces. A blank is written as the marker U+2581, one marker is put in front,
and decoding turns this round.

The trie walk and the Viterbi steps run in numpy over many text units at once. A
unit is a run of markers and what follows up to the next marker: no piece goes
across such a border (checked when the model is loaded; else a text is one unit),
so the best sequence of a text is that of its units. Each distinct unit is solved
once while the bounded memo holds it.

Scores are logarithms: natural ones of a Zipf law over the order of the file's
scores (``log_scores="zipf"``, as files of merge models hold merge ranks), or the
file's own numbers (``"file"``, for unigram model files).

Defined results: null and empty texts have no ids and decode to an empty text; a
literal U+2581 counts as a blank and decodes to one; invalid byte runs decode to
U+FFFD; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe.llm.text import slices

MARK = "▁"
MEMO_UNITS = 400_000
UNK_PENALTY = 10.0  # below the lowest score, as the library has it
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


@dataclass
class Pieces:
    """Plain arrays of a model, small enough for every task: its size is that of the vocabulary."""

    texts: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unk: int
    cut: bool


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: the child of s by byte b is base[s] + b + 1, if check names s."""
    root: dict = {}
    for key, number in keys:
        node = root
        for b in key:
            node = node.setdefault(b + 1, {})
        node[-1] = number
    arrays = [np.zeros(1 << 16, np.int32), np.full(1 << 16, -1, np.int32), np.full(1 << 16, -1, np.int32)]

    def grow() -> None:
        for i, fill in enumerate((0, -1, -1)):
            arrays[i] = np.concatenate([arrays[i], np.full(len(arrays[i]), fill, np.int32)])

    arrays[1][0] = 0
    # Where nodes with so many children last found room; earlier gaps are left to smaller ones.
    since: dict[int, int] = {}
    queue = [(0, root)]
    for state, node in queue:
        if -1 in node:
            arrays[2][state] = node[-1]
        codes = np.array(sorted(c for c in node if c > 0), dtype=np.int64)
        if not len(codes):
            continue
        at = max(since.get(len(codes), 1), 1)
        while True:
            if at + 257 + 512 >= len(arrays[1]):
                grow()
            window = arrays[1][at:at + 512 + 257] < 0
            fits = np.logical_and.reduce([window[c:c + 512] for c in codes])
            if fits.any():
                at += int(fits.argmax())
                break
            at += 512
        since[len(codes)] = at
        arrays[0][state] = at
        arrays[1][at + codes] = state
        queue.extend((at + int(c), node[int(c)]) for c in codes)
    used = int(np.flatnonzero(arrays[1] >= 0)[-1]) + 1
    # Every state may be asked for any byte.
    used = max(used, int(arrays[0][:used].max()) + 258)
    while len(arrays[1]) < used:
        grow()
    return arrays[0][:used], arrays[1][:used], arrays[2][:used]


def load(path: str, log_scores: str = "zipf") -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, model.unk_id(), np.int32)
    texts: list[bytes] = []
    plain: list[int] = []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            texts.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"" if model.is_control(i) else " ⁇ ".encode())
        else:
            texts.append(name.encode())
            plain.append(i)
    scores = np.array([model.get_score(i) for i in range(n)], np.float64)
    if log_scores == "zipf":
        order = sorted(plain, key=lambda i: (-scores[i], i))
        ranks = np.arange(1, len(order) + 1, dtype=np.float64)
        scores = np.zeros(n)
        # Single precision, as the library keeps scores.
        scores[order] = (-np.log(ranks * (1 / ranks).sum())).astype(np.float32)
    elif log_scores != "file":
        raise ValueError(f"log_scores must be 'zipf' or 'file', not {log_scores!r}")
    base, check, value = double_array([(texts[i], i) for i in plain])
    cut = not any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain)
    scores[model.unk_id()] = (scores[plain].min() if plain else 0.0) - UNK_PENALTY
    return Pieces(texts, scores, byte_ids, base, check, value, model.unk_id(), cut)


def viterbi(units: list[bytes], pieces: Pieces) -> list[np.ndarray]:
    """Best ids of each non-empty UTF-8 unit."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    # A zero after each unit ends every walk; bytes are shifted up by one.
    buf = np.zeros(int(lengths.sum()) + len(units) + 1, np.int32)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    flat = np.frombuffer(b"\0".join(units), np.uint8)
    buf[:len(flat)] = flat.astype(np.int32) + 1
    stops = first + lengths
    buf[stops] = 0
    inside = np.flatnonzero(buf)
    opens = inside[(buf[inside] - 1) & 0xC0 != 0x80]
    lead = buf[opens] - 1
    width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))

    froms, tos, ids = [], [], []
    at, state, wide, depth = opens, np.zeros(len(opens), np.int64), width, 0
    single = np.zeros(len(buf), bool)
    while len(at):
        step = pieces.base[state] + buf[at + depth]
        alive = (buf[at + depth] > 0) & (pieces.check[step] == state)
        at, state, wide = at[alive], step[alive].astype(np.int64), wide[alive]
        depth += 1
        found = pieces.value[state]
        hit = found >= 0
        froms.append(at[hit])
        tos.append(at[hit] + depth)
        ids.append(found[hit])
        single[at[hit & (wide == depth)]] = True
    lone = ~single[opens]
    froms.append(opens[lone])
    tos.append(opens[lone] + width[lone])
    ids.append(np.full(int(lone.sum()), pieces.unk))
    start, end, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)

    unit_of = np.repeat(np.arange(len(units)), lengths + 1)
    place = start - first[unit_of[start]]
    order = np.argsort(place, kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    gain = pieces.scores[piece]
    best = np.full(len(buf), -np.inf)
    best[first] = 0.0
    back, by = np.zeros(len(buf), np.int64), np.zeros(len(buf), np.int32)
    counts = np.bincount(place)
    lo = 0
    for n in counts[counts > 0].tolist():  # all steps that start at one place of their units
        s, e = start[lo:lo + n], end[lo:lo + n]
        score = best[s] + gain[lo:lo + n]
        up = score > best[e]
        e = e[up]
        best[e], back[e], by[e] = score[up], s[up], piece[lo:lo + n][up]
        lo += n

    unit, step, got_from, got_to, got = [], [], [], [], []
    here, which, k = stops.copy(), np.arange(len(units)), 0
    while len(here):
        prev = back[here]
        unit.append(which)
        step.append(np.full(len(which), k))
        got_from.append(prev)
        got_to.append(here)
        got.append(by[here])
        more = prev > first[which]
        here, which, k = prev[more], which[more], k + 1
    unit, step = np.concatenate(unit), np.concatenate(step)
    order = np.lexsort((-step, unit))
    unit, a, b, out = unit[order], np.concatenate(got_from)[order], np.concatenate(got_to)[order], np.concatenate(got)[order]
    unknown = out == pieces.unk
    if unknown.any():  # byte fallback
        n = np.where(unknown, b - a, 1)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spread = np.repeat(unknown, n)
        at = np.repeat(a, n)[spread] + within[spread]
        out, unit = np.repeat(out, n), np.repeat(unit, n)
        out[spread] = pieces.byte_ids[buf[at] - 1]
    cuts = np.searchsorted(unit, np.arange(1, len(units)))
    return np.split(out.astype(np.int32), cuts)


class Coder:
    """Encodes and decodes whole texts; keeps a bounded memo of units."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memo: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str]:
        """Units without their first marker."""
        if not text:
            return []
        if not self.pieces.cut:
            return [text.replace(" ", MARK)]
        parts = text.split(" ")
        if MARK not in text and "" not in parts:
            return parts
        return [u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._units(t) for t in texts]
        needed = set().union(*split)
        new = needed - self.memo.keys()
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.memo.clear()
            new = needed
        # Units of like length go together: a batch takes as many steps as its longest.
        new = sorted(new, key=len)
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            for unit, ids in zip(some, viterbi([(MARK + u).encode() for u in some], self.pieces)):
                self.memo[unit] = ids.tobytes()
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), np.int32) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _shared(spark, path: str, log_scores: str):
    return spark.sparkContext.broadcast(load(path, log_scores))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           log_scores: str = "zipf") -> DataFrame:
    """``key`` and ids of every text."""
    sent = _shared(docs.sparkSession, path, log_scores)

    def run(batches):
        coder = Coder(sent.value)
        for batch in slices(batches):
            ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids",
           log_scores: str = "zipf") -> DataFrame:
    """``key`` and decoded text; null ids decode to an empty text."""
    sent = _shared(encoded.sparkSession, path, log_scores)

    def run(batches):
        coder = Coder(sent.value)
        for batch in slices(batches):
            texts = [coder.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    named = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return named.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


CODED = "n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean, ids array<int>"


def encode_and_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                      log_scores: str = "zipf") -> DataFrame:
    """``key``, ids, counts and checksums, and whether decoding gives the text again (markers as blanks).

    ids_crc32 is that of the ids as little-endian uint32, decoded_crc32 that of the decoded text in UTF-8.
    """
    sent = _shared(docs.sparkSession, path, log_scores)

    def run(batches):
        pieces = sent.value
        coder = Coder(pieces)
        is_byte = np.zeros(len(pieces.texts), bool)
        is_byte[pieces.byte_ids[pieces.byte_ids != pieces.unk]] = True
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = coder.encode(texts)
            back = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                pa.array([a.replace(MARK, " ") == b for a, b in zip(texts, back)], pa.bool_()),
                _lists(ids)],
                names=["key", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "round_trip", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {kind}, {CODED}").withColumnRenamed("key", key)
