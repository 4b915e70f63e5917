"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed into embedding tables: the whole word, its first 4 and first 6
bytes and its last 4, so that words formed from a known stem count as well. The
rows are put side by side as the word's vector. Filters of several widths run over
the vectors, each filter keeps its maximum over the whole text, and a logistic
layer scores these.

Thresholds are calibrated by language: on training rows kept from fitting, each
predicted language (predicted from the text; see ``language``) gets the cut that
errs least, and the score is moved so that this cut is 0.5. Languages with few
positive rows there share the common cut.

Training reads every word of every labelled row: from a net fitted to ``MOST`` rows of each class,
buckets of all rows go on by themselves, and their mean is the net. Cuts count all rows kept from
fitting. Scoring reads every word of every text.

Defined results: null texts and texts without words are scored by the bias alone;
repeated label rows count once, by their largest label, and null labels are none;
without labelled rows every score is 0; repeated rows give one row each; other
columns are never read.
"""

from __future__ import annotations

import copy
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe.llm import language
from inkprobe.llm.samples import per_class
from inkprobe.llm.text import as_bytes, slices, words
from inkprobe.session import materialize, small

N_TABLES = 4  # whole word, two lengths of its start, its end
TABLE_ROWS = 1 << 16
DIMS = 6  # of each table
WIDTHS = (1, 2, 3)
FILTERS = 12  # of each width
MOST = 1_500
MOST_WORDS = 2_000
WINDOWS = 4
EPOCHS = 8
MIN_STEPS = 800  # small samples go through more epochs
BATCH = 32
RATE = 0.05
WORD_RATE = 20.0
DROP = 0.2
START = 0.05
SEED = 42
FEW = 8  # positives a language needs for a cut of its own
STEP_WORDS = 1 << 15
BUCKET_ROWS = 2_048  # labelled rows that go through one local pass
UNIT = 1 << 40  # changes are added up as whole numbers of this part
CUT_STEPS = 1_024  # logits are counted by this part of one
_COLUMNS = [f"d{i}" for i in range(DIMS)]
_MULTIPLIER = 0x9E3779B1


@dataclass
class Net:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # width x (N_TABLES * DIMS) x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    cuts: dict[str, float] = field(default_factory=dict)  # logits by language; "" for all others


def hashed(data: bytes | None) -> np.ndarray:
    """CRC-32 of each lower-cased word, its starts and its end: one row a word."""
    split, crc = words(data), zlib.crc32
    out = np.empty((len(split), N_TABLES), np.uint32)
    out[:, 0] = list(map(crc, split))
    out[:, 1] = [crc(w[:4]) for w in split]
    out[:, 2] = [crc(w[:6]) for w in split]
    out[:, 3] = [crc(w[-4:]) for w in split]
    return out


def rows_of(crcs: np.ndarray) -> list[np.ndarray]:
    """Row of each word in each table."""
    bits = TABLE_ROWS.bit_length() - 1
    mixed = (crcs * np.uint32(_MULTIPLIER)) >> np.uint32(32 - bits)
    return [mixed[:, k].astype(np.int64) for k in range(N_TABLES)]


def _pooled(net: Net, crcs: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
            where: bool = False, owned: int = STEP_WORDS) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Maximum of each filter over each run of words (runs hold at least one), and where it is.

    Only the first ``owned`` words of a run are places; later ones belong to the next run of that text.
    """
    rows = rows_of(crcs)
    vectors = np.concatenate([t[r] for t, r in zip(net.tables, rows)], axis=1)
    pad = max(WIDTHS) - 1
    vectors = np.concatenate([vectors, np.zeros((pad, vectors.shape[1]), vectors.dtype)])
    n = len(crcs)
    left = np.repeat(starts + lengths, lengths) - np.arange(n)
    best, places = [], []
    for weights, bias in zip(net.filters, net.bias):
        width = len(weights)
        value = vectors[:n] @ weights[0]
        for j in range(1, width):
            # Words beyond the end of the text count as zero vectors.
            value += np.where((left > j)[:, None], vectors[j:n + j] @ weights[j], 0)
        value += bias
        value[np.arange(n) - np.repeat(starts, lengths) >= owned] = -np.inf
        top = np.maximum.reduceat(value, starts, axis=0)
        best.append(top)
        if where:
            spot = np.where(value == np.repeat(top, lengths, axis=0), np.arange(n)[:, None], n)
            places.append(np.minimum.reduceat(spot, starts, axis=0))
    top = np.concatenate(best, axis=1)
    return np.maximum(top, 0), np.concatenate(places, axis=1) if where else None, vectors


def logits(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    """Logit of each text, given its word hashes; runs of bounded length are pooled together."""
    features = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
    overlap = max(WIDTHS) - 1
    runs = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), STEP_WORDS)]
    start = 0
    while start < len(runs):
        stop, size, parts = start, 0, []
        while stop < len(runs) and size < STEP_WORDS:
            i, at = runs[stop]
            parts.append(texts[i][at:at + STEP_WORDS + overlap])
            size += len(parts[-1])
            stop += 1
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        top, _, _ = _pooled(net, np.concatenate(parts), np.cumsum(lengths) - lengths, lengths, owned=STEP_WORDS)
        np.maximum.at(features, np.array([i for i, _ in runs[start:stop]]), top)
        start = stop
    return features.astype(np.float64) @ net.out + net.out_bias


def begin(seed: int = SEED) -> tuple[Net, dict, np.random.Generator]:
    """An untrained net, the sums of squares of its gradients, and the generator that goes on from it."""
    rng = np.random.default_rng(seed)
    dims = N_TABLES * DIMS
    net = Net(
        [rng.normal(0, START, (TABLE_ROWS, DIMS)).astype(np.float32) for _ in range(N_TABLES)],
        [rng.normal(0, 0.3, (w, dims, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)), 0.0)
    sums = {"f": [np.full(f.shape, 1e-6, np.float32) for f in net.filters],
            "b": [np.full(FILTERS, 1e-6, np.float32) for _ in WIDTHS],
            "o": np.full(net.out.shape, 1e-6), "ob": 1e-6}
    return net, sums, rng


def class_weights(n_pos: int, n: int) -> np.ndarray:
    """Weight of a row of label 0 and of label 1: both classes weigh the same, a row 1 on average."""
    return np.array([0.5 / max(1, n - n_pos), 0.5 / max(1, n_pos)]) * n


def one_pass(net: Net, sums: dict, rng: np.random.Generator, texts: list[np.ndarray], labels: np.ndarray,
             full: np.ndarray, balance: np.ndarray) -> None:
    """Go once through the texts ``full`` in random order, changing ``net`` and ``sums``."""
    dims = N_TABLES * DIMS
    for batch in np.array_split(rng.permutation(full), max(1, len(full) // BATCH)):
        if not len(batch):
            continue
        parts = [texts[i] for i in batch]
        kept = [p[rng.random(len(p)) >= DROP] for p in parts]
        parts = [k if len(k) else p for k, p in zip(kept, parts)]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        crcs = np.concatenate(parts)
        starts = np.cumsum(lengths) - lengths
        top, places, vectors = _pooled(net, crcs, starts, lengths, where=True, owned=len(crcs))
        z = top @ net.out + net.out_bias
        delta = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * balance[labels[batch].astype(int)] / len(batch)
        back = (delta[:, None] * net.out[None, :] * (top > 0)).astype(np.float32)
        grad = top.T @ delta
        sums["o"] += grad ** 2
        net.out -= RATE * grad / np.sqrt(sums["o"])
        sums["ob"] += delta.sum() ** 2
        net.out_bias -= RATE * delta.sum() / np.sqrt(sums["ob"])
        ends = (starts + lengths)[:, None]
        rows = rows_of(crcs)
        hit_words, hit_grads = [], []
        for k, weights in enumerate(net.filters):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            b, p = back[:, own], places[:, own]
            grad_f = np.zeros_like(weights)
            for j in range(len(weights)):
                inside = (p + j < ends)
                q = np.minimum(p + j, len(crcs) - 1)
                bj = np.where(inside, b, 0)
                grad_f[j] = np.einsum("df,dfe->ef", bj, vectors[q])
                hit_words.append(q.ravel())
                hit_grads.append((bj[:, :, None] * weights[j].T[None]).reshape(-1, dims))
            grad_b = b.sum(axis=0)
            sums["f"][k] += grad_f ** 2
            sums["b"][k] += grad_b ** 2
            net.filters[k] = weights - RATE * grad_f / np.sqrt(sums["f"][k])
            net.bias[k] = net.bias[k] - RATE * grad_b / np.sqrt(sums["b"][k])
        at, grads = np.concatenate(hit_words), np.concatenate(hit_grads)
        alive = np.abs(grads).sum(axis=1) > 0
        at, grads = at[alive], grads[alive]
        for k in range(N_TABLES):
            np.add.at(net.tables[k], rows[k][at], -WORD_RATE * grads[:, k * DIMS:(k + 1) * DIMS])


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """:func:`fit_from_start` without the random start."""
    return ended(fit_from_start(texts, labels, epochs, seed)[0], seed)


def ended(net: Net, seed: int = SEED) -> Net:
    """``net`` without the random start of its word vectors."""
    return replace(net, tables=[t - b for t, b in zip(net.tables, begin(seed)[0].tables)])


def fit_from_start(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> tuple[Net, dict]:
    """Minimise the class-balanced logistic loss; gradients reach only the words that won a maximum.

    Filters and weights go by Adagrad. Word vectors go by plain gradient steps, so
    that a word counts by how often it helped; the random start, which lets words
    compete for the maxima, is taken away in the end, so that words never or rarely
    seen say little. A share of the words is left out at random.
    """
    net, sums, rng = begin(seed)
    full = np.flatnonzero([len(t) > 0 for t in texts])
    balance = class_weights(int(labels.sum()), len(labels))
    epochs = max(epochs, -(-MIN_STEPS * BATCH // max(1, len(full))))
    for _ in range(epochs):
        one_pass(net, sums, rng, texts, labels, full, balance)
    return net, sums


def near_winners(net: Net, crcs: np.ndarray) -> np.ndarray:
    """Of a text beyond ``STEP_WORDS`` words, those that a filter's maximum over the whole text lies on; else all.

    Gradients reach no others, so every word is looked at and none has to be held for a step. Where kept
    stretches meet, windows of words can form that the text doesn't have.
    """
    if len(crcs) <= STEP_WORDS:
        return crcs
    overlap, best, spot = max(WIDTHS) - 1, None, None
    for at in range(0, len(crcs), STEP_WORDS):
        part = crcs[at:at + STEP_WORDS + overlap]
        top, places, _ = _pooled(net, part, np.array([0]), np.array([len(part)]), where=True, owned=STEP_WORDS)
        top, places = top[0], places[0] + at
        if best is None:
            best, spot = top, places
        else:
            spot = np.where(top > best, places, spot)
            best = np.maximum(best, top)
    held = np.unique((spot[:, None] + np.arange(max(WIDTHS))).ravel())
    return crcs[held[held < len(crcs)]]


def _best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The logit between two scores where the balanced error is least, in the middle of the widest such gap.

    With ``n`` an entry stands for so many rows, ``y`` of them positive.
    """
    order = np.argsort(z)
    z, y = z[order], y[order]
    n = np.ones(len(z)) if n is None else n[order]
    pos, neg = max(1, int(y.sum())), max(1, int((n - y).sum()))
    # Cutting before element i: positives below are missed, negatives from i on are false alarms.
    missed = np.concatenate([[0], np.cumsum(y)]) / pos
    false = (np.concatenate([[0], np.cumsum(n - y)])[-1] - np.concatenate([[0], np.cumsum(n - y)])) / neg
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gaps = np.diff(edges)
    error = missed + false
    good = np.flatnonzero(error <= error.min() + 1e-12)
    i = good[np.argmax(gaps[good])]
    return float((edges[i] + edges[i + 1]) / 2)


def calibrate(net: Net, z: np.ndarray, y: np.ndarray, langs: list[str], n: np.ndarray | None = None) -> None:
    """Set the cut of each language with enough rows of both labels, and the common one; ``n`` as :func:`_best_cut`."""
    n = np.ones(len(z)) if n is None else n
    net.cuts = {"": _best_cut(z, y, n) if len(z) and 0 < y.sum() < n.sum() else 0.0}
    names = np.array(langs)
    for name in sorted(set(langs)):
        own = names == name
        if FEW <= y[own].sum() <= n[own].sum() - FEW:
            net.cuts[name] = _best_cut(z[own], y[own], n[own])


def scores(net: Net, z: np.ndarray, langs: list[str]) -> np.ndarray:
    cuts = np.array([net.cuts.get(name, net.cuts.get("", 0.0)) for name in langs])
    return 1 / (1 + np.exp(-np.clip(z - cuts, -50, 50)))


def windowed(rows: np.ndarray) -> np.ndarray:
    """The words of a text to learn from: all, or of a long one windows from its start to its end."""
    if len(rows) <= MOST_WORDS:
        return rows
    size = MOST_WORDS // WINDOWS
    starts = np.linspace(0, len(rows) - size, WINDOWS).astype(int)
    return np.concatenate([rows[a:a + size] for a in starts])


def _changes(net: Net, after: Net) -> pa.Table:
    """What a bucket's pass changed, as whole numbers of 1 / ``UNIT``, so that sums do not depend on their order."""
    parts = []
    for k, (old, new) in enumerate(zip([*net.tables, _dense(net)], [*after.tables, _dense(after)])):
        change = np.rint((new.astype(np.float64) - old) * UNIT).astype(np.int64)
        at = np.flatnonzero(change.any(axis=1)) if k < N_TABLES else np.arange(len(change))
        parts.append((np.full(len(at), k), at, change[at]))
    kind, at, change = [np.concatenate(p) for p in zip(*parts)]
    return pa.table([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), *[pa.array(change[:, i]) for i in range(DIMS)]],
                    names=["kind", "at", *_COLUMNS])


def _dense(net: Net) -> np.ndarray:
    """Filters, biases and weights in rows of ``DIMS``."""
    flat = np.concatenate([*[f.ravel() for f in net.filters], *net.bias, net.out, [net.out_bias]]).astype(np.float64)
    return np.pad(flat, (0, -len(flat) % DIMS)).reshape(-1, DIMS)


def _moved(net: Net, kind: np.ndarray, at: np.ndarray, change: np.ndarray) -> Net:
    """``net`` with the mean changes added."""
    tables = [t.copy() for t in net.tables]
    for k, table in enumerate(tables):
        table[at[kind == k]] += change[kind == k].astype(np.float32)
    dense = _dense(net)
    dense[at[kind == N_TABLES]] += change[kind == N_TABLES]
    flat, filters, start = dense.ravel(), [], 0
    for f in net.filters:
        filters.append(flat[start:start + f.size].reshape(f.shape).astype(np.float32))
        start += f.size
    bias = [flat[start + k * FILTERS:start + (k + 1) * FILTERS].astype(np.float32) for k in range(len(WIDTHS))]
    start += FILTERS * len(WIDTHS)
    return Net(tables, filters, bias, flat[start:start + len(net.out)].copy(), float(flat[start + len(net.out)]))


def train(docs: DataFrame, labels: DataFrame, speak: language.Model | None, key: str = "doc_id",
          text: str = "text", label: str = "toxic", most: int = MOST, holdout: int = 5) -> Net | None:
    """Fit and calibrate on all labelled rows; None without rows of both labels.

    Every ``holdout``-th key (by hash) is kept from fitting, for the cuts. The rows to learn from lie in buckets
    of a hash of their key. A net fitted to a bounded sample is only where all buckets start: each goes
    through all words of its own rows, and the mean of the changes, of a word's vector over the buckets that changed
    it, is added (local gradient steps, then averaging). The cuts come from counts of all rows kept aside.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(label).cast("int").alias("label"))
    marked = materialize(marked, "marked")
    fold = F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(holdout)).cast("int")
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # One row a key, however many rows repeat it.
    rows = materialize(named.join(small(marked, marked.count()), "key").groupBy("key", "label").agg(
        F.min("text").alias("text")).withColumn("fold", fold), "labelled")
    known = {(r["aside"], r["label"]): r["n"] for r in rows.groupBy(
        (F.col("fold") == 0).alias("aside"), "label").agg(F.count("*").alias("n")).collect()}
    if not all(any(known.get((aside, y)) for aside in (False, True)) for y in (0, 1)):
        return None
    use = rows.filter("fold <> 0") if all(known.get((False, y)) for y in (0, 1)) else rows
    counted = {r["label"]: r["n"] for r in use.groupBy("label").agg(F.count("*").alias("n")).collect()}
    balance = class_weights(counted[1], counted[0] + counted[1])

    start, sums = _start(use, most)
    buckets = -(-(counted[0] + counted[1]) // BUCKET_ROWS)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((start, sums))

    def learn(table: pa.Table) -> pa.Table:
        net, squares = copy.deepcopy(sent.value)
        table = table.sort_by("place")
        texts = [near_winners(net, hashed(t)) for t in as_bytes(table.column("text"))]
        full = np.flatnonzero([len(t) > 0 for t in texts])
        one_pass(net, squares, np.random.default_rng([SEED, table.column("bucket")[0].as_py()]), texts,
                 table.column("label").to_numpy().astype(np.float64), full, balance)
        return _changes(sent.value[0], net)

    place = F.xxhash64(F.lit(SEED + 1), "key")
    dealt = use.select(F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"), place.alias("place"), "label", "text")
    schema = "kind int, at int" + "".join(f", {c} bigint" for c in _COLUMNS)
    changes = dealt.groupBy("bucket").applyInArrow(learn, schema).groupBy("kind", "at").agg(
        *[(F.sum(c) / F.count("*") / UNIT).alias(c) for c in _COLUMNS]).toArrow()  # at most a row of each table row
    stack = np.stack([changes.column(c).to_numpy() for c in _COLUMNS], axis=1)
    net = ended(_moved(start, changes.column("kind").to_numpy(), changes.column("at").to_numpy(), stack))
    _set_cuts(rows.filter("fold = 0"), net, speak)
    return net


def _start(use: DataFrame, most: int) -> tuple[Net, dict]:
    """A net to start from, and its sums of squares, of at most ``most`` rows of each class and windows of their texts."""
    picked = F.broadcast(per_class(use, "key", "label", most, SEED))

    def prepare(batches):
        for batch in slices(batches):
            crcs = [windowed(hashed(t)).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(crcs, pa.binary())],
                                             names=["label", "crcs"])

    own = use.join(picked, ["key", "label"]).select("label", "text").mapInArrow(
        prepare, "label bigint, crcs binary").collect()
    own.sort(key=lambda r: (r["label"], bytes(r["crcs"])))
    return fit_from_start([np.frombuffer(bytes(r["crcs"]), np.uint32).reshape(-1, N_TABLES) for r in own],
                          np.array([r["label"] for r in own], np.float64))


def _set_cuts(aside: DataFrame, net: Net, speak: language.Model | None) -> None:
    """Calibrate on all rows of ``aside``: they are counted by language and logit, in steps of 1 / ``CUT_STEPS``."""
    sent = aside.sparkSession.sparkContext.broadcast((net, speak))

    def scored(batches):
        own, spoken = sent.value
        for batch in slices(batches):
            z = np.clip(logits(own, [hashed(t) for t in as_bytes(batch.column(0))]), -50, 50)
            langs, _ = language.predict(batch.column(0).to_pylist(), spoken)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.rint(z * CUT_STEPS).astype(np.int64)), batch.column(1)],
                names=["lang", "z", "label"])

    counts = aside.select("text", "label").mapInArrow(scored, "lang string, z bigint, label int").groupBy(
        "lang", "z").agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy("lang", "z").toArrow()
    z, y, n = [counts.column(c).to_numpy().astype(np.float64) for c in ("z", "y", "n")]
    calibrate(net, z / CUT_STEPS, y, counts.column("lang").to_pylist(), n)


def score(docs: DataFrame, net: Net | None, speak: language.Model | None, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``key`` and score of every row; 0.5 is the calibrated cut."""
    sent = docs.sparkSession.sparkContext.broadcast((net, speak))

    def run(batches):
        own, spoken = sent.value
        for batch in slices(batches):
            if own is None:
                found = np.zeros(batch.num_rows)
            else:
                z = logits(own, [hashed(t) for t in as_bytes(batch.column(1))])
                langs, _ = language.predict(batch.column(1).to_pylist(), spoken)
                found = scores(own, z, langs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
