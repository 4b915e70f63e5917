"""Exact duplicates by two-pass Bloom filtering.

Pass 1 counts how many rows touch each cell of a blocked Bloom filter and keeps,
as bitmaps, the cells touched at least twice. Pass 2 tests each row: only where
all its cells are such, its text may be repeated. These rows alone shuffle to be
grouped; every other row is unique for certain and passes straight through.

The filter grows with the rows, two bytes for each. While it is small it is
broadcast; beyond that every row meets the one bitmap it needs in a shuffle, in
which rows of hot bitmaps stay scattered. Either way texts are read twice, whatever their number.

Texts are equal when identical after each run of white space (0x20, 0x09-0x0D)
becomes one space; equality is that of the SHA-256 of that text.

Defined results: a null text counts as empty; of equal texts the row with the
smallest key stays, a null key comes last; of rows equal in key and text, one
stays and all count in the group's size; an empty table gives no rows.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprobe.functions.skew import lookup
from inkprobe.llm.skewed import join_groups
from inkprobe.session import materialize

CELLS_PER_BITMAP = 32_768
BITS_PER_ROW = 16
PROBES = 3
BITMAP_BYTES = 3 * (CELLS_PER_BITMAP // 8)  # of a bitmap in a broadcast table, with room to spare


def normalised(text: str | Column = "text") -> Column:
    """Text with each run of white space as one space; null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    # A single space stays as it is, so only other runs are matched and replaced.
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(col, F.lit("")), runs, " ")


def text_sha256(text: str | Column = "text") -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _cells(digest: str, n_bitmaps: int) -> Column:
    """The cells of a row: ``PROBES`` places in one bitmap."""
    h = F.xxhash64(digest)
    bitmap = F.pmod(h, F.lit(n_bitmaps))
    return F.array(*[bitmap * CELLS_PER_BITMAP + F.pmod(F.xxhash64(F.lit(i), digest), F.lit(CELLS_PER_BITMAP))
                     for i in range(PROBES)])


def repeated_cells(keys: DataFrame, digest: str, n_bitmaps: int) -> DataFrame:
    """Pass 1: (bitmap, bits) with the cells that at least two rows touch."""
    cells = keys.select(F.explode(_cells(digest, n_bitmaps)).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n >= 2")
    return twice.groupBy(F.expr(f"cell div {CELLS_PER_BITMAP}").alias("bitmap")).agg(
        F.bitmap_construct_agg(F.col("cell") % CELLS_PER_BITMAP).alias("bits"))


def _bit(bits: Column, place: Column) -> Column:
    """The bit of a bitmap at ``place``, as a condition."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0


def maybe_repeated(rows: DataFrame, digest: str, cells: DataFrame, n_bitmaps: int,
                   keys: DataFrame | None = None) -> DataFrame:
    """Pass 2: add ``_maybe``; false only for rows that are unique for certain.

    ``keys`` holds the digests of ``rows`` where these are costly to make again.
    """
    tagged = rows.withColumn("_number", F.monotonically_increasing_id()).withColumn(
        "_cells", _cells(digest, n_bitmaps)).withColumn("bitmap", F.expr(f"_cells[0] div {CELLS_PER_BITMAP}"))
    # How many rows ask for each bitmap follows from the digests alone.
    asked = (rows if keys is None else keys).groupBy(F.pmod(F.xxhash64(digest), F.lit(n_bitmaps)).alias("bitmap")).agg(F.count("*").alias("n"))
    met = lookup(tagged, cells, ["bitmap"], ["bits"], ["_number"], n_bitmaps, asked, row_bytes=BITMAP_BYTES)
    all_set = _bit(F.col("bits"), F.col("_cells")[0] % CELLS_PER_BITMAP)
    for i in range(1, PROBES):
        all_set = all_set & _bit(F.col("bits"), F.col("_cells")[i] % CELLS_PER_BITMAP)
    return met.withColumn("_maybe", F.coalesce(all_set, F.lit(False))).select(*rows.columns, "_maybe")


def filter_size(n_rows: int) -> int:
    """Bitmaps of the filter."""
    return max(1, -(-n_rows * BITS_PER_ROW // CELLS_PER_BITMAP))


def _filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """The stored filter of ``keys`` (digest), and its bitmaps."""
    n_bitmaps = filter_size(keys.count())
    return materialize(repeated_cells(keys, "digest", n_bitmaps), "bloom"), n_bitmaps


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key``, keep_id, group_size, kept, text_sha256."""
    keys = materialize(docs.select(F.col(key).alias("id"), text_sha256(text).alias("digest")), "digests")
    tested = maybe_repeated(keys, "digest", *_filter(keys.select("digest")))
    alone = tested.filter(~F.col("_maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "digest")
    rows = materialize(tested.filter("_maybe").groupBy("digest", "id").agg(F.count("*").alias("n")), "candidates")
    groups = materialize(rows.groupBy("digest").agg(
        F.min("id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    # Rows equal in key and text come back one by one; the first of the smallest key stays.
    shared = join_groups(rows, groups, "digest", "group_size").select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy")).select(
        "id", "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")
    out = alone.unionByName(shared)
    return out.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the later copies of a text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"),
                        text_sha256(text).alias("digest"))
    keys = materialize(whole.select("digest"), "digests")
    n_bitmaps = filter_size(keys.count())
    cells = materialize(repeated_cells(keys, "digest", n_bitmaps), "bloom")
    tested = maybe_repeated(whole, "digest", cells, n_bitmaps, keys)
    alone = tested.filter(~F.col("_maybe")).select("row")
    first = F.min_by("row", F.struct(F.col("id").isNull(), "id", "text")).alias("row")
    kept = tested.filter("_maybe").groupBy("digest").agg(first).select("row")
    return alone.unionByName(kept).select("row.*")
