"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a value that lies within half the
radius of both. So every distinct fingerprint emits all values within half the
radius, values meet in one shuffle, and all that emitted a value are linked to
the smallest of them, with the distance checked. A value is emitted by as many
fingerprints as its half ball holds at most (65 for radius 2), whatever the data;
copies share one fingerprint and never form pairs.

Defined results: texts without words (null, empty, blank) have fingerprint zero
and link like any other; a text with fewer words than a shingle is one shingle;
repeated rows give one row each; a null key never names a component unless all
keys of it are null; dropping near copies leaves one row of each component, also
where keys are null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprobe.llm.components import components
from inkprobe.llm.skewed import join_groups
from inkprobe.llm.text import LOWER, as_bytes, slices
from inkprobe.session import materialize

SHINGLE = 3
RADIUS = 2
BITS = 64
HASH_SEED = 42
_CHUNK = 65_536


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, bit 0 first."""
    if len(hashes) <= 512:
        return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    per_byte = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(per_byte[:, i], minlength=256) @ byte_bits for i in range(8)])


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text over its word shingles, as an unsigned number."""
    words = data.translate(LOWER).split() if data else []
    if not words:
        return 0
    k = min(shingle, len(words))
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(words) - k + 1]
    ends = ends[k - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        lo, hi = starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist()
        hashes = [digest(line[a:b], HASH_SEED) for a, b in zip(lo, hi)]
        counts += _bit_counts(np.array(hashes, dtype=np.uint64))
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(starts)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``key``, fp) with the fingerprint as a signed 64-bit number."""
    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def _masks(flips: int) -> list[int]:
    """All 64-bit values with at most ``flips`` bits set, as signed numbers."""
    values = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BITS), n)]
    return [v - (1 << BITS) if v >> (BITS - 1) else v for v in values]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(lo, hi) links between distinct fingerprints ``fp``; connects all within ``radius`` bits."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4: values meet halfway")
    ball = F.array(*[F.lit(m).cast("bigint") for m in _masks(radius // 2)])
    met = distinct.select("fp", F.explode(F.transform(ball, lambda m: m.bitwiseXOR(F.col("fp")))).alias("value"))
    # Any two that emitted a value are within the radius, so links to the smallest connect them all.
    least = met.withColumn("lo", F.min("fp").over(W.partitionBy("value")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lo"))) <= radius
    return least.filter((F.col("fp") != F.col("lo")) & near).select("lo", F.col("fp").alias("hi")).distinct()


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _heads(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, head, n) of stored rows (key, number, fp): the first row of each fingerprint's component.

    Rows come by key, null last, then by number. A component may hold most fingerprints, so its head
    reaches them by :func:`join_groups`.
    """
    first = F.struct(F.col("key").isNull().alias("none"), "key", "number")
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = materialize(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    heads = materialize(rooted.groupBy("root").agg(
        F.min("first").alias("head"), F.count("*").alias("size")), "heads")
    return materialize(join_groups(rooted, heads, "root", "size").select("fp", "head", "n"), "component-names")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per row: ``key``, fp and component_id, the smallest key reachable over links."""
    found = fingerprints(docs, key, text, shingle).select(
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("number"), "fp")
    rows = materialize(found, "fingerprints")
    return join_groups(rows, _heads(rows, radius), "fp", "n").select(
        F.col("key").alias(key), "fp", F.col("head.key").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                         radius: int = RADIUS) -> DataFrame:
    """The first row of each component, all columns.

    Rows come by key, then in the order they are read; a row without a key stays
    only where its component has no key at all, and of rows that share a key each goes by its own text.
    """
    if not docs.columns:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # The row's number ties its fingerprint to it, whatever the keys; it is stored, so both readings agree.
    stored = materialize(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    named = stored.select("number", F.col("row").getField(text).alias("text"))
    keys = stored.select("number", F.col("row").getField(key).alias("key"))
    found = materialize(fingerprints(named, "number", "text", shingle), "fingerprints")
    rows = materialize(found.join(keys, "number").select("key", "number", "fp"), "keyed-fingerprints")
    gone = join_groups(rows, _heads(rows, radius), "fp", "n").filter(
        F.col("number") != F.col("head.number")).select("number")
    return stored.join(gone, "number", "left_anti").select("row.*")
