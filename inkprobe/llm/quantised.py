"""Near-duplicate embeddings of one label, by int8 tile products with rigorous error bounds.

Rows with equal label and vector become one class. Classes are ordered by label
and along a Hilbert curve, and cut into tiles. Every unit vector of a tile is
rounded to int8 steps of its own, and the length of what rounding took away is
kept. Two tiles meet when their caps (mean direction and largest angle) leave
room for a pair; the product of their int8 rows, exact in float32, then bounds
all cosines: with u = u' + r, v = v' + s, u.v differs from u'.v' by no more than
|u'||s| + |r||v|. Only pairs whose bound reaches the threshold are computed in
double precision. A task that met two tiles returns one row for each linked
class: how many vectors it is linked to there, and the smallest class that the
links of the two tiles lead to. So a cluster of m vectors gives rows in
proportion to m and never its m * m pairs.

Defined results: a row whose label is null, or whose vector is null, empty, zero
or holds null or non-finite entries, links with nothing and is its own component;
vectors of different lengths don't link; rows equal in label and vector link to
each other; null keys count as vectors but name a component only where it has no
other key; rows that share a key have its component each by their own vector;
an empty table gives no rows. The input is read twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe.llm.components import components
from inkprobe.llm.skewed import join_groups
from inkprobe.llm.vectors import hilbert_keys
from inkprobe.session import materialize

THRESHOLD = 0.98
TILE = 1_024
CURVE_BITS = 2
PAIRS_AT_ONCE = 65_536
LEVELS = 127
ROUNDING = 1e-12  # more than double arithmetic loses in a product of unit vectors
FLOAT32_EXACT = 1 << 24
META_SALTS = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest entry first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, step of each row, length of each row's rounding error, rounded up)."""
    step = np.abs(u).max(axis=1) / LEVELS
    q = np.rint(u / step[:, None]).astype(np.int8)
    rest = u - q * step[:, None]
    return q, step, np.sqrt((rest * rest).sum(axis=1)) * (1 + ROUNDING) + ROUNDING


def upper_bounds(qa, step_a, err_a, qb, step_b, err_b) -> np.ndarray:
    """No cosine of a row of a with a row of b is higher."""
    kind = np.float32 if qa.shape[1] * LEVELS * LEVELS < FLOAT32_EXACT else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    product *= step_a[:, None] * step_b[None, :]
    return product + ((1 + err_a)[:, None] * err_b[None, :] + err_a[:, None] + ROUNDING)


def linked(a: np.ndarray, b: np.ndarray, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs at or above the threshold in double precision, of those the bounds let through."""
    i, j = np.nonzero(bounds >= threshold)
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        keep[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
    return i[keep], j[keep]


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places, the smallest that links (i, j) lead to."""
    least = np.arange(n)
    while True:
        before = least.copy()
        both = np.minimum(least[i], least[j])
        np.minimum.at(least, i, both)
        np.minimum.at(least, j, both)
        least = least[least]
        if (least == before).all():
            return least


# ------------------------------------------------------------------- classes

def _digest(label: bytes, row: np.ndarray) -> bytes:
    return hashlib.blake2b(b"%d:%d:" % (len(label), len(row)) + label + row.tobytes(), digest_size=20).digest()


def _digested(named: DataFrame, kind: str, with_vectors: bool) -> DataFrame:
    """Digest of label and vector, null for rows that link with nothing; with the vectors, only the others."""
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
            # -0.0 becomes 0.0, as both are the same vector.
            values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            ends = np.cumsum(lengths)
            digests, vectors = [], []
            for label, lo, hi in zip(batch.column(2).to_pylist(), (ends - lengths).tolist(), ends.tolist()):
                row = values[lo:hi]
                good = label is not None and hi > lo and np.isfinite(row).all() and row.any()
                digests.append(_digest(label.encode(), row) if good else None)
                vectors.append(row.tobytes() if good and with_vectors else None)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                names=["key", "label", "digest", "x"])
            yield out.filter(pc.is_valid(out.column(2))) if with_vectors else out

    return named.mapInArrow(run, f"key {kind}, label string, digest binary, x binary")


def tiles(classes: DataFrame) -> DataFrame:
    """Stored tiles of at most ``TILE`` classes of one label and width, in curve order."""
    def place(batches):
        for batch in batches:
            data = batch.column(2).to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            keys = np.empty(len(data), object)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                u = unit(np.frombuffer(b"".join(data[i] for i in at.tolist())).reshape(len(at), -1))
                cells = np.floor((u * np.sqrt(u.shape[1]) / 4 + 0.5) * (1 << CURVE_BITS))
                keys[at] = hilbert_keys(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary())], names=["node", "label", "x", "n", "place"])

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        group, held = None, []
        for batch in batches:
            for node, label, x, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held and (group != (label, len(x)) or len(held) == TILE):
                    yield _tile(number, *group, held)
                    number, held = number + 1, []
                group = (label, len(x))
                held.append((node, n, x))
        if held:
            yield _tile(number, *group, held)

    def _tile(number, label, size, held) -> pa.RecordBatch:
        u = unit(np.frombuffer(b"".join(x for _, _, x in held)).reshape(len(held), -1))
        mean = u.mean(axis=0)
        length = np.sqrt((mean * mean).sum())
        middle = mean / length if length > 1e-6 else u[0]
        angle = float(np.arccos(np.clip(u @ middle, -1, 1)).max()) + 1e-6
        q, step, error = quantise(u)
        return pa.RecordBatch.from_pylist([{
            "tile": number, "label": label, "width": size // 8, "middle": middle.tolist(), "angle": angle,
            "nodes": [node for node, _, _ in held], "weights": [n for _, n, _ in held],
            "u": u.tobytes(), "q": q.tobytes(), "step": step.tobytes(), "error": error.tobytes()}], schema=TILE_ARROW)

    placed = classes.select("node", "label", "x", "n").mapInArrow(
        place, "node bigint, label string, x binary, n bigint, place binary").withColumn(
        "width", F.octet_length("x"))
    order = ["label", "width", "place", "node"]
    in_order = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "label", "x", "n")
    return materialize(in_order.mapInArrow(cut, TILE_SCHEMA), "tiles")


TILE_SCHEMA = ("tile bigint, label string, width int, middle array<double>, angle double, nodes array<bigint>, "
               "weights array<bigint>, u binary, q binary, step binary, error binary")
TILE_ARROW = pa.schema([
    ("tile", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("middle", pa.list_(pa.float64())),
    ("angle", pa.float64()), ("nodes", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())),
    ("u", pa.binary()), ("q", pa.binary()), ("step", pa.binary()), ("error", pa.binary())])


def meetings(cut: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the tiles, a <= b, between which a link is possible by their caps; salted by label."""
    side = lambda t: cut.select(
        "label", "width", F.col("tile").alias(t), F.col("middle").alias(f"m_{t}"), F.col("angle").alias(f"r_{t}"))
    a = side("a").withColumn("_s", F.pmod(F.xxhash64("a"), F.lit(META_SALTS)).cast("int"))
    b = side("b").withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(META_SALTS)])))
    dot = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))
    room = F.col("r_a") + F.col("r_b") + float(np.arccos(threshold)) + 1e-6
    met = a.join(b, ["label", "width", "_s"]).filter(F.col("a") <= F.col("b"))
    return met.filter((F.col("a") == F.col("b")) | (between <= room)).select("a", "b")


def tile_links(cut: DataFrame, threshold: float) -> DataFrame:
    """(node, links, least): linked vectors elsewhere and the smallest node reached, for each meeting of two tiles."""
    def product(found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        sides = []
        for r in sorted(rows, key=lambda r: r["tile"]):
            w = r["width"]
            sides.append((np.array(r["nodes"]), np.array(r["weights"]), np.frombuffer(r["u"]).reshape(-1, w),
                          np.frombuffer(r["q"], np.int8).reshape(-1, w), np.frombuffer(r["step"]),
                          np.frombuffer(r["error"])))
        a, b = sides[0], sides[-1]
        bounds = upper_bounds(*a[3:], *b[3:])
        if len(sides) == 1:
            bounds = np.where(np.tri(len(a[0]), dtype=bool), -2.0, bounds)  # each pair once
        i, j = linked(a[2], b[2], bounds, threshold)
        base = 0 if len(sides) == 1 else len(a[0])
        nodes = a[0] if len(sides) == 1 else np.concatenate([a[0], b[0]])
        order = np.argsort(nodes, kind="stable")
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, i, b[1][j])
        np.add.at(links, base + j, a[1][i])
        back = np.empty(len(nodes), np.int64)
        back[order] = np.arange(len(nodes))
        least = nodes[order][smallest_reached(len(nodes), back[i], back[base + j])][back]
        some = np.flatnonzero(links)
        return pa.table({"node": nodes[some], "links": links[some], "least": least[some]})

    pairs = meetings(cut, threshold)
    each = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    sent = each.join(cut.select("tile", "width", "nodes", "weights", "u", "q", "step", "error"), "tile")
    return sent.groupBy("a", "b").applyInArrow(product, "node bigint, links bigint, least bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``key``, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    named = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"),
                           F.col(f"`{label}`").cast("string").alias("label"))
    kind = named.schema["key"].dataType.simpleString()
    rows = materialize(_digested(named, kind, False).select("key", "digest"), "vector-digests")
    grouped = _digested(named, kind, True).groupBy("digest").agg(
        F.min("key").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("x").alias("x"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = materialize(tile_links(tiles(classes), threshold), "tile-links")
    roots = components(found.filter("least < node").select(F.col("least").alias("lo"), F.col("node").alias("hi")).distinct())
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = materialize(
        classes.select("node", "digest", "first", "n").join(links, "node", "left").join(roots, "node", "left").select(
            "digest", "first", "n", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
            F.coalesce("root", "node").alias("root")), "rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "heads")
    per_class = materialize(join_groups(rooted, heads, "root", "size").select(
        "digest", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "class-components")
    found_rows = join_groups(rows.filter("digest IS NOT NULL"), per_class, "digest", "n").select(
        "key", "n_links", "component_id")
    alone = rows.filter("digest IS NULL").select(
        "key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return found_rows.unionByName(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
