import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe.llm import quantised, queries, vectors, whitening, zonemaps

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("x", T.LongType()),
    T.StructField("node", T.StringType()), T.StructField("an odd, name", T.StringType())])


def _odd_rows(width=64):
    """Nulls, wrong lengths, zeros, repeated rows and keys, near copies; columns named like internal ones."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[0] + rng.normal(size=(6, width)) * 0.008
    rows = [(i, v, i % 2) for i, v in enumerate(base.tolist())]
    rows += [(100 + i, v, 0) for i, v in enumerate(near.tolist())]
    rows += [(7, base[7].tolist(), 1), (7, base[7].tolist(), 1), (7, base[3].tolist(), 1), (None, base[1].tolist(), 1)]
    rows += [(30, None, 1), (31, [None] * width, 1), (32, [float("nan")] * width, 1), (33, [0.0] * width, 1),
             (34, [], 1), (35, [1.0] * 3, 1), (36, base[1].tolist(), None), (37, [float("inf")] * width, 1),
             (None, None, None), (38, [1e30] * width, 1), (39, [1e30] * width, 1), (40, [-0.0] * width, 0)]
    return [(*r, "k", 1, "n", "o") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA).repartition(3)


def _usable(rows, width=None):
    out = []
    for r in rows:
        v = r.embedding
        if v and all(x is not None and math.isfinite(x) for x in v) and (width is None or len(v) == width):
            out.append((r.vec_id, v, r.label))
    return out


# ----------------------------------------------------------------- curve

def test_hilbert_keys_walk_the_whole_grid_one_step_at_a_time():
    for axes, bits in ((2, 4), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * axes), -1).reshape(-1, axes)
        keys = vectors.hilbert_keys(cells, bits)
        assert len(set(keys)) == side ** axes
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ------------------------------------------------------------- whitening

def _matrix(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 40),
    np.concatenate([[5, 5 + 1e-7, 5 + 2e-7, 5 + 1e-4], np.linspace(1, 2, 20)]),  # closer than float32 parts
    [3.0] * 6 + [1.0] * 6,                                                       # multiple
    [7 + 1e-9 * i for i in range(10)],                                           # one cluster in all
    [1e-30, 2e-30, 5e-30], [1e12, 1.0, 1e-3, 0.0], [0.0, 0.0], [4.0],
])
def test_eigenvectors_reach_double_precision(values):
    a = _matrix(values)
    a = (a + a.T) / 2
    got, x = whitening.principal(a)
    size = max(abs(np.array(values)).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15 * len(values)
    assert np.abs(a @ x - x * got).max() < 4e-16 * len(values) * size
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-14 * len(values) * size


def test_corrections_part_eigenvalues_that_float32_mixes_up():
    values = [1, 1 + 1e-9, 1 + 3e-9, 2, 3]
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(5, 5)))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q @ (3 * np.eye(5, dtype=np.longdouble) - q.T @ q) / 2
    a = (q * np.array(values, np.longdouble)) @ q.T
    x = whitening.eigenvectors(a)
    fit = np.abs((q.T @ x).astype(float))
    assert np.abs(np.sort(fit, axis=0)[-1] - 1).max() < 1e-12 and np.sort(fit, axis=0)[-2].max() < 1e-8
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    assert np.sort(np.abs(q.T.astype(float) @ rough), axis=0)[-2].max() > 1e-3


def _check_whitening(table, rows):
    widths = defaultdict(int)
    for _, v, _ in rows:
        widths[len(v)] += 1
    width = max(widths, key=lambda w: (widths[w], w))
    rows = [r for r in rows if len(r[1]) == width]
    model = whitening.fit(table)
    got = whitening.whiten(table, model).collect()
    k = min(8, width)
    assert len(got) == k * len(rows)
    big = lambda v: [min(max(math.floor(1024 * float(c)), -(1 << 39)), 1 << 39) + 100_000 for c in v]
    x = [big(v) for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[float(c - Fraction(s, n)) for c, s in zip(row, sums)] for row in x])
    cov = y.T @ y / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    want = y @ basis / np.sqrt(values)
    deviations = sorted(sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x)
    fits = [d if d < 1 << 63 else None for d in deviations]
    assert sorted((r.deviation for r in got if r.component == 1), key=lambda d: (d is None, d)) == fits
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
        assert r.n == n
    for c in range(k):
        assert by[c + 1][0].explained == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
    return model, by, want, [r[0] for r in rows]


def test_whitened_rows_equal_numpy(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").repartition(5)
    model, by, want, ids = _check_whitening(table, _usable(table.collect()))
    place = {i: n for n, i in enumerate(ids)}
    for c in range(8):
        own = np.array([r.whitened for r in sorted(by[c + 1], key=lambda r: place[r.vec_id])])
        sign = np.sign(own @ want[:, c])
        assert np.abs(own * sign - want[:, c]).max() < 1e-8
    assert whitening.identity_error(table, model) < 1e-12


def test_whitening_of_odd_rows(odd, spark):
    plain = odd.filter("vec_id IS NULL OR vec_id NOT IN (38, 39)")
    _check_whitening(plain, _usable(plain.collect()))
    huge = whitening.fit(odd)  # entries beyond every long
    rows = whitening.whiten(odd, huge).collect()
    assert {r.deviation for r in rows if r.vec_id == 38} == {None}
    assert whitening.identity_error(odd, huge) < 1e-4


def test_whitening_without_spread_or_rows(spark, odd):
    one = odd.filter("vec_id = 100")
    model = whitening.fit(one)
    assert {(r.whitened, r.deviation, r.explained) for r in whitening.whiten(one, model).collect()} == {(None, 0, None)}
    assert whitening.identity_error(one, model) is None
    none = odd.limit(0)
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
    model = whitening.fit(flat)
    got = whitening.whiten(flat, model).collect()
    assert {r.whitened for r in got if r.component == 2} == {None}
    assert whitening.identity_error(flat, model) < 1e-12


# ---------------------------------------------------------- near duplicates

def _brute_links(rows, threshold=0.98):
    good = [i for i, r in enumerate(rows) if r.label is not None and r.embedding
            and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    unit = {}
    for i in good:
        v = np.array(rows[i].embedding, float)
        v = v / np.abs(v).max()
        unit[i] = v / np.linalg.norm(v)
    links = defaultdict(set)
    for i in good:
        for j in good:
            if i < j and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j].vec_id for j in seen if rows[j].vec_id is not None), default=None)
        out.append((r.vec_id, len(links[i]), least, r.vec_id == least))
    return sorted(map(str, out))


def test_near_duplicates_equal_brute_force(odd, spark, monkeypatch):
    for tile in (4, 1_024):
        monkeypatch.setattr(quantised, "TILE", tile)
        assert sorted(str(tuple(r)) for r in quantised.near_duplicates(odd).collect()) == _brute_links(odd.collect())


def test_a_large_cluster_and_chains_of_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=16)
    rows = [(i, (middle + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(150)]
    # A chain on a circle: neighbours are linked, ends are far apart.
    rows += [(1_000 + i, [math.cos(i * 0.15), math.sin(i * 0.15)], 2) for i in range(40)]
    rows += [(2_000 + i, rng.normal(size=16).tolist(), i % 3) for i in range(80)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    monkeypatch.setattr(quantised, "TILE", 16)
    want = _brute_links(table.collect())
    assert sorted(str(tuple(r)) for r in quantised.near_duplicates(table).collect()) == want
    # Rows out of the tile products follow the vectors and not the pairs.
    kept = quantised.near_duplicates(table).filter("component_id = 0")
    assert kept.count() == 150


def test_int8_bounds_hold_and_let_few_pairs_through():
    rng = np.random.default_rng(8)
    u = quantised.unit(rng.normal(size=(300, 64)) * rng.uniform(0.1, 10, size=(300, 1)))
    q, step, error = quantised.quantise(u)
    bounds = quantised.upper_bounds(q, step, error, q, step, error)
    exact = u @ u.T
    assert (bounds >= exact).all() and (bounds - exact).max() < 0.05
    spiky = quantised.unit(np.where(rng.random((100, 64)) < 0.02, 50.0, rng.normal(size=(100, 64)) * 1e-3))
    q, step, error = quantised.quantise(spiky)
    assert (quantised.upper_bounds(q, step, error, q, step, error) >= spiky @ spiky.T).all()


def test_tiles_out_of_reach_do_not_meet(spark):
    rows = [(i, [1.0, 0.0, 0.001 * (i % 7)] if i < 40 else [0.0, 1.0, 0.001 * (i % 7)], 1) for i in range(80)]
    table = spark.createDataFrame(rows, "node bigint, e array<double>, label string")
    packed = table.rdd.map(lambda r: (r.node, r.label, bytearray(np.array(r.e).tobytes()), 1)).toDF(
        "node bigint, label string, x binary, n bigint")
    cut = quantised.tiles(packed.repartition(4))
    assert cut.count() == quantised.meetings(cut, 0.98).filter("a = b").count()
    ends = {r.tile: r.middle[0] > 0.7 for r in cut.collect()}
    assert all(ends[r.a] == ends[r.b] for r in quantised.meetings(cut, 0.98).collect())


def test_no_vectors(odd):
    assert quantised.near_duplicates(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quantised.near_duplicates(odd, threshold=0.0)


# ------------------------------------------------------------------- clusters

def _brute_clusters(rows, k=8, rounds=10):
    clip = lambda x: min(max(math.floor(1024 * float(x)), -(1 << 27)), 1 << 27)
    kept = [(i, [clip(x) for x in v], v) for i, v, _ in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centres = [r[1] for r in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        to = [near(v)[1] for _, v, _ in kept]
        for c in range(len(centres)):
            own = [v for (_, v, _), t in zip(kept, to) if t == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    last = [(i, *near(v)) for i, v, _ in kept]
    total = sum(d for _, d, _ in last)
    per = defaultdict(int)
    for _, d, c in last:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    held = lambda n: n if n < 1 << 63 else None
    return sorted(str((i, c, d, held(per[c]), held(total), sha[c])) for i, d, c in last)


def test_clusters_equal_plain_rounds(odd, spark, monkeypatch):
    real = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(150)
    real = spark.createDataFrame(real.collect(), real.schema).repartition(3)
    for size in (8, 1_024):
        monkeypatch.setattr(zonemaps, "BLOCK_ROWS", size)
        for table in (odd, real, odd.filter("vec_id < 5")):
            got = sorted(str(tuple(r)) for r in zonemaps.assign(zonemaps.fit(table)).collect())
            assert got == _brute_clusters(_usable(table.collect(), 64))


def test_boxes_rule_out_only_centroids_that_are_never_nearest():
    rng = np.random.default_rng(4)
    ruled_out = 0
    for _ in range(50):
        centres = rng.integers(-100, 100, size=(12, 3))
        x = rng.integers(-20, 20, size=(30, 3)) + rng.integers(-80, 80, size=3)
        some = zonemaps.candidates(x.min(axis=0), x.max(axis=0), centres)
        dist = ((x[:, None] - centres) ** 2).sum(axis=2)
        assert set(dist.argmin(axis=1)) <= set(some.tolist())
        ruled_out += 12 - len(some)
        to, d = zonemaps.nearest(x.astype(np.int32), x.min(axis=0), x.max(axis=0), centres)
        assert (to == dist.argmin(axis=1)).all() and (d == dist.min(axis=1)).all()
    assert ruled_out > 100


def test_clusters_of_nothing(odd):
    assert zonemaps.assign(zonemaps.fit(odd.limit(0))).count() == 0


def test_registered_queries_have_their_columns(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    white = queries.op11_whitening(spark, FOLDER)
    assert white.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert white.count() == 8 * rows and white.agg(F.max("identity_error")).first()[0] < 1e-4
    assert queries.op12_embedding_dedup(spark, FOLDER).columns == ["vec_id", "n_links", "component_id", "kept"]
