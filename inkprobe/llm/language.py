"""Language identification by string kernels.

The kernel of two texts counts the n-grams (1 to ``MAX_N`` characters, blended
spectrum) that both hold, as presence and not frequency, and divides by the
geometric mean of the counts in each. Over ``landmarks`` training windows the
Nystroem method turns it into features, on which one ridge regression a language
(against the rest) is solved. Scoring multiplies a batch's presence matrix by the
landmarks' presence matrix and then by the solved coefficients.

A whole text is scored as the mean over its windows of ``WINDOW`` characters,
weighted by their lengths; long texts would otherwise hold every n-gram. N-grams
are those of the landmarks, over an alphabet of the most frequent characters of
the training windows; others are one common sign.

Training is bounded: at most ``PER_LANGUAGE`` labelled rows of each language and
one window of each. Prediction reads every window of every text.

Defined results: null texts and texts without a letter give ``und`` and score 0;
rows with a null language or null key are not learned from; with no labelled row
at all everything is ``und``; repeated rows give one row each; other columns are
never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe.llm.samples import per_class
from inkprobe.llm.text import slices

UNDETERMINED = "und"
MAX_N = 3
WINDOW = 2_048
ALPHABET = 64
LANDMARKS = 32  # of each language
PER_LANGUAGE = 400
RIDGE = 1e-3
SEED = 42
SLICE_CHARS = 1 << 18
_MAYBE = re.compile(r"[^\W\d_]")  # letters, and signs of numbers such as a half


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter; signs of numbers are none."""
    return any(m.group().isalpha() for m in _MAYBE.finditer(text)) if text else False


_LUT = 1 << 16


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # code point -> sign
    tables: list[np.ndarray]  # for n = 1.. : n-gram number -> column, or -1
    landmarks: np.ndarray  # n-grams x landmarks
    sizes: np.ndarray  # n-grams held by each landmark
    weights: np.ndarray  # landmarks x languages


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts in a row, and the length of each."""
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    data = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(data, _LUT - 1), lengths


def _alphabet(texts: list[str]) -> np.ndarray:
    """Sign 0: any rare character; 1: white space; 2: digits; then the most frequent others."""
    codes, _ = _codes(texts)
    counts = np.bincount(codes, minlength=_LUT)
    lut = np.zeros(_LUT, np.uint8)
    fixed = np.array([i for i in range(_LUT - 1) if chr(i).isspace() or chr(i).isdigit()])
    counts[fixed] = 0
    for rank, code in enumerate(np.argsort(-counts, kind="stable")[:ALPHABET - 3]):
        if counts[code]:
            lut[code] = rank + 3
    lut[fixed] = [1 if chr(i).isspace() else 2 for i in fixed]
    return lut


def _grams(signs: np.ndarray, n: int) -> np.ndarray:
    out = signs[:len(signs) - n + 1].astype(np.int64)
    for i in range(1, n):
        out = out * ALPHABET + signs[i:len(signs) - n + 1 + i]
    return out


def presence(texts: list[str], model_alphabet: np.ndarray, tables: list[np.ndarray],
             n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x n-grams presence, text of each window, its length); windows end with their text."""
    codes, lengths = _codes(texts)
    signs = model_alphabet[codes]
    ends = np.cumsum(lengths)
    n_windows = np.maximum(1, -(-lengths // WINDOW))
    base = np.cumsum(n_windows) - n_windows
    text_of = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(len(signs)) - (ends - lengths)[text_of]
    window = base[text_of] + within // WINDOW
    left = ends[text_of] - np.arange(len(signs))  # characters to the end of the text
    total = int(n_windows.sum())
    held = np.zeros((total, n_columns), np.float32)
    for n, table in enumerate(tables, 1):
        if len(signs) < n:
            break
        column = table[_grams(signs, n)]
        ok = (column >= 0) & (left[:len(column)] >= n)
        held[window[:len(column)][ok], column[ok]] = 1.0
    sizes = np.bincount(window, minlength=total)
    return held, np.repeat(np.arange(len(texts)), n_windows), sizes


def _kernel(held: np.ndarray, model_landmarks: np.ndarray, model_sizes: np.ndarray) -> np.ndarray:
    own = held.sum(axis=1)
    return (held @ model_landmarks) / np.sqrt(np.maximum(own, 1.0)[:, None] * np.maximum(model_sizes, 1.0)[None, :])


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """A model of (language, text window) rows; None without rows."""
    rows = [(lang, text) for lang, text in rows if has_letter(text)]
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    texts = [text for _, text in rows]
    alphabet = _alphabet(texts)
    chosen: list[str] = []
    for lang in languages:
        own = [t for name, t in rows if name == lang]
        # The longest windows hold most n-grams; equal ones are taken once.
        chosen += sorted(dict.fromkeys(own), key=lambda t: (-len(t), t))[:LANDMARKS]
    codes, lengths = _codes(chosen)
    signs = alphabet[codes]
    cut = np.cumsum(lengths)[:-1]
    tables, column = [], 0
    for n in range(1, MAX_N + 1):
        found = np.unique(np.concatenate([_grams(s, n) for s in np.split(signs, cut) if len(s) >= n] or [np.zeros(0, np.int64)]))
        table = np.full(ALPHABET ** n, -1, np.int32)
        table[found] = np.arange(column, column + len(found))
        column += len(found)
        tables.append(table)
    held, owner, _ = presence(chosen, alphabet, tables, column)
    first = np.searchsorted(owner, np.arange(len(chosen)))
    landmarks = np.ascontiguousarray(held[first].T)
    sizes = landmarks.sum(axis=0)
    core = _kernel(landmarks.T, landmarks, sizes).astype(np.float64)
    values, vectors = np.linalg.eigh(core)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    blocks = []
    for i in range(0, len(texts), 256):
        held, owner, _ = presence(texts[i:i + 256], alphabet, tables, column)
        blocks.append(_kernel(held, landmarks, sizes)[np.searchsorted(owner, np.arange(len(texts[i:i + 256])))])
    features = np.vstack(blocks) @ root
    target = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Every language counts alike, however many rows it has.
    share = np.array([1.0 / sum(1 for name, _ in rows if name == lang) for lang, _ in rows])[:, None]
    gram = features.T @ (features * share) + RIDGE * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(gram, features.T @ (target * share))
    return Model(languages, alphabet, tables, landmarks, sizes, weights.astype(np.float32))


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each whole text."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    at = [i for i, t in enumerate(texts) if has_letter(t)]
    start = 0
    while start < len(at):  # pieces of bounded size; a longer text is cut at windows below
        stop, size = start, 0
        while stop < len(at) and (stop == start or size + len(texts[at[stop]]) <= SLICE_CHARS):
            size += len(texts[at[stop]])
            stop += 1
        some = [texts[i] for i in at[start:stop]]
        margin = np.zeros((len(some), len(model.languages)))
        weight = np.zeros(len(some))
        step = SLICE_CHARS - SLICE_CHARS % WINDOW
        for cut in range(0, max(map(len, some)), step):
            part = [(j, t[cut:cut + step]) for j, t in enumerate(some) if len(t) > cut]
            held, owner, sizes = presence([t for _, t in part], model.alphabet, model.tables, len(model.landmarks))
            got = _kernel(held, model.landmarks, model.sizes) @ model.weights
            who = np.array([j for j, _ in part])[owner]
            np.add.at(margin, who, got * sizes[:, None])
            np.add.at(weight, who, sizes)
        margin /= np.maximum(weight, 1)[:, None]
        best = margin.argmax(axis=1)
        for j, i in enumerate(at[start:stop]):
            names[i] = model.languages[best[j]]
            scores[i] = min(1.0, max(0.0, (margin[j, best[j]] + 1) / 2))
        start = stop
    return names, scores


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most ``per_language`` rows of each language of ``docs`` and one window of each."""
    named = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = per_class(named.select("key", "lang"), "key", "lang", per_language, SEED)

    def window(batches):
        for batch in slices(batches):
            cut = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = -(-len(t or "") // WINDOW)
                at = (zlib.crc32(str(k).encode()) % n) * WINDOW if n else 0
                cut.append((t or "")[at:at + WINDOW])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cut, pa.string())], names=["key", "lang", "text"])

    picked = F.broadcast(sample)  # per_language keys a language
    rows = named.join(picked, ["key", "lang"]).select("key", "text", "lang")
    kind = named.schema["key"].dataType.simpleString()
    # One window of a key and language, however many rows repeat them.
    found = rows.mapInArrow(window, f"key {kind}, lang string, text string").groupBy("key", "lang").agg(
        F.min("text").alias("text")).collect()
    most: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["text"])):
        most.setdefault(r["lang"], []).append(r["text"])
    return fit([(name, t) for name, own in most.items() for t in own])


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            names, scores = predict(batch.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["key", "lang_pred", "score"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = T.StructType().add("key", named.schema["key"].dataType).add("lang_pred", "string").add("score", "double")
    return named.mapInArrow(run, out).withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told; texts without a letter go.

    Without a model, as where no row has a language to learn from, those with a letter stay.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    if model is None:
        return whole.filter(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}"))).select("row.*")
    return identify(whole, model, "row").filter(F.col("lang_pred") != UNDETERMINED).select("row.*")
