"""Benchmark decontamination by Wu-Manber search for word windows.

Windows of a benchmark item are ``window`` consecutive words; an item with fewer
words is one window. A document word inside any occurrence of a window is hit.

Wu-Manber works on words here. For windows of m words a table gives, for each
block of two words that ends a stretch of m, how far the search may move on: a
block in no window allows a move of m - 1 words, so most positions are never
looked at. A move of 0 leads to the bucket of the windows that end in this
block, whose first word and then whole length are compared directly.

The benchmark is a stated query set. It goes to the executors in blocks of at
most ``block_words`` words; more blocks mean more passes over the documents,
never fewer windows.

Defined results: null and empty texts have no words and are never contaminated;
items without words cannot occur; a null item id counts its hits but is no item;
repeated document rows give one result row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkprobe.llm.text import as_bytes, slices, words
from inkprobe.session import materialize

WINDOW = 13
BLOCK_WORDS = 200_000
PIECE_WORDS = 1_000
FOUND = "n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<lo: int, hi: int>>"
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


class WordSearch:
    """Wu-Manber tables for windows that all have ``m`` words."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set[int | None]]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.windows = windows
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[tuple[bytes, ...]]] = {}
        for window in windows:
            for end in range(self.block, m + 1):
                key = b" ".join(window[end - self.block:end])
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.buckets.setdefault(key, []).append(window)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, window) of every occurrence."""
        m, far, get, two = self.m, self.far, self.shift.get, self.block == 2
        at, n = m - 1, len(text)
        while at < n:
            key = text[at - 1] + b" " + text[at] if two else text[at]
            move = get(key, far)
            if move:
                at += move
                continue
            start = at - m + 1
            first = text[start]
            for window in self.buckets[key]:
                if window[0] == first and tuple(text[start:at + 1]) == window:
                    yield start, window
            at += 1


def searches(pieces: list[tuple[int | None, bytes]], window: int) -> list[WordSearch]:
    """One search per window length that the pieces hold."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int | None]]] = {}
    for item, data in pieces:
        split = data.split()
        m = min(window, len(split))
        found = by_length.setdefault(m, {})
        for i in range(len(split) - m + 1):
            found.setdefault(tuple(split[i:i + m]), set()).add(item)
    return [WordSearch(m, found) for m, found in sorted(by_length.items())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Words of the items, long items cut into pieces that share ``window`` - 1 words."""
    def run(batches):
        for batch in slices(batches):
            rows: list[tuple[int | None, bytes, int]] = []
            for key, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                split = words(data)
                for start in range(0, max(1, len(split) - window + 1), PIECE_WORDS):
                    piece = split[start:start + PIECE_WORDS + window - 1]
                    if piece:
                        rows.append((key, b" ".join(piece), len(piece)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.int64())], names=["item", "words", "n"])

    named = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("words"))
    kind = named.schema["item"].dataType.simpleString()
    return named.mapInArrow(run, f"item {kind}, words binary, n bigint")


def _scan(docs: DataFrame, pieces: list[tuple[object, bytes]], window: int, kind: T.DataType) -> DataFrame:
    """Add what the windows of one block of pieces find to each row of ``docs`` (``row``, ``text``).

    ``kind`` is the type of the item ids.
    """
    id_type = to_arrow_type(kind)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        tables = searches(sent.value, window)
        for batch in slices(batches):
            counts, hits, items, spans = [], [], [], []
            for data in as_bytes(batch.column(1)):
                text = words(data)
                seen: set[object] = set()
                found: list[tuple[int, int]] = []
                for table in tables:
                    for start, at in table.find(text):
                        found.append((start, start + table.m))
                        seen |= table.windows[at]
                merged = _merged(found)
                counts.append(len(text))
                hits.append(sum(hi - lo for lo, hi in merged))
                items.append(sorted(x for x in seen if x is not None))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                 pa.array(items, pa.list_(id_type)), pa.array(spans, _SPANS)],
                names=["row", "n_words", "n_hit", "items", "spans"])

    found = [T.StructField("items", T.ArrayType(kind)) if f.name == "items" else f for f in T.StructType.fromDDL(FOUND)]
    out = T.StructType([T.StructField("row", docs.schema["row"].dataType), *found])
    return docs.select("row", "text").mapInArrow(run, out)


def _overlay(parts: DataFrame) -> DataFrame:
    """Join the findings of several blocks for each row number."""
    gathered = parts.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Spans arrive in order, so each adds what lies beyond the furthest end so far.
    hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["hi"]).alias("end")),
        lambda acc: acc["n"])
    return gathered.select("row", "n_words", hit.alias("n_hit"), "items", "spans")


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text", window: int = WINDOW,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key``, n_words, n_hit, items and hit word spans of every document row."""
    pieces = materialize(_pieces(benchmark, item, item_text, window), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))
    kind = pieces.schema["item"].dataType
    if n_blocks == 1:
        rows = [(r["item"], bytes(r["words"])) for r in pieces.collect()]
        named = docs.select(F.col(key).alias("row"), F.col(text).alias("text"))
        return _scan(named, rows, window, kind).withColumnRenamed("row", key)
    # A row number ties the passes together; it is stored, so every pass sees the same.
    numbered = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")),
        "numbered")
    block = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks))
    parts = None
    for i in range(n_blocks):
        rows = [(r["item"], bytes(r["words"])) for r in pieces.filter(block == i).collect()]
        # Rows without a hit matter once, for their number of words.
        found = _scan(numbered, rows, window, kind).filter((F.col("n_hit") > 0) | F.lit(i == 0))
        found = materialize(found, "found")
        parts = found if parts is None else parts.unionByName(found)
    whole = numbered.select("row", "key").join(_overlay(parts), "row")
    return whole.select(F.col("key").alias(key), "n_words", "n_hit", "items", "spans")


def contaminated() -> Column:
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def items_digest(items: str = "items") -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    ids = F.array_sort(F.transform(F.col(items), lambda i: i.cast("string")))
    return F.sha2(F.array_join(ids, ",").cast("binary"), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                      item_text: str = "text", window: int = WINDOW,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    if not docs.columns:
        return docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = search(whole, benchmark, "row", "text", item, item_text, window, block_words)
    return found.filter(~contaminated()).select("row.*")
