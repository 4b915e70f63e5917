"""Licence scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Word ``GRAM``-grams of the templates and of each text are hashed and winnowed: of
every ``WINNOW`` consecutive hashes the smallest (the last of equal ones) is kept,
so any common run of GRAM + WINNOW - 1 words shares a fingerprint. An inverted
index leads from a fingerprint to its places in the templates. Hits of one template
that lie close together in a text make a candidate, which is aligned word by word
in a band around the hits' diagonals. Matches report the covered share of the
template and the span in the text, in code points.

A template with fewer words than a gram is one gram of its own length and is
looked for as such a gram only; templates without words are never found.

Defined results: null and empty texts match nothing; every repetition in a text is
reported; of overlapping matches the one that covers most words stays, ties go to
the first template by name; repeated rows give one row each; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprobe.llm.license_texts import TEMPLATES
from inkprobe.llm.text import as_bytes, slices, words

GRAM = 3
WINNOW = 3
MIN_COVERAGE = 0.8
BAND = 4
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    names: list[str]
    words: list[list[int]]  # word hashes of each template
    prints: np.ndarray  # sorted distinct fingerprints
    places: list[list[tuple[int, int]]]  # (template, word) of each
    short: list[tuple[int, tuple[int, ...]]]  # templates of fewer words than a gram


def _grams(crcs: np.ndarray) -> np.ndarray:
    n = len(crcs) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = (out ^ crcs[i:n + i]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the kept hashes, rising."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= WINNOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())])
    n = len(hashes) - WINNOW + 1
    best, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, WINNOW):
        later = hashes[i:n + i]
        less = later <= best
        best = np.where(less, later, best)
        at = np.where(less, np.arange(i, n + i), at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if n > 1 else at


def build(templates: dict[str, str]) -> Index:
    names = sorted(templates)
    split = [[zlib.crc32(w) for w in words(templates[name].encode())] for name in names]
    found: dict[int, list[tuple[int, int]]] = {}
    short = []
    for t, crcs in enumerate(split):
        if 0 < len(crcs) < GRAM:
            short.append((t, tuple(crcs)))
        hashes = _grams(np.array(crcs, np.uint64))
        for at in winnow(hashes).tolist():
            found.setdefault(int(hashes[at]), []).append((t, at))
    prints = np.array(sorted(found), np.uint64)
    return Index(names, split, prints, [found[int(p)] for p in prints], short)


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of the whole template inside ``text``.

    Cell (i, j) is in the band if ``low`` <= j - i <= ``high``. A match gives 2, a
    difference or gap takes 1; text before and after is free.
    """
    nothing = (0, 0, -1, 0)  # score, matched, first, end
    before: dict[int, tuple[int, int, int, int]] = {j: nothing for j in range(max(0, low - 1), min(len(text), high) + 1)}
    for i, word in enumerate(template):
        now: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + 1 + low - 1), min(len(text), i + 1 + high) + 1):
            options = []
            if j and j - 1 in before:
                s, m, a, b = before[j - 1]
                if text[j - 1] == word:
                    options.append((s + 2, m + 1, j - 1 if a < 0 else a, j))
                else:
                    options.append((s - 1, m, a, b))
            if j in before:
                s, m, a, b = before[j]
                options.append((s - 1, m, a, b))
            if j - 1 in now:
                s, m, a, b = now[j - 1]
                options.append((s - 1, m, a, b))
            now[j] = max(options, key=lambda o: o[0]) if options else (-1 - i, 0, -1, 0)
        before = now
        if not before:
            return 0, 0, 0
    best = max(before.values(), key=lambda o: o[0])
    return best[1], max(best[2], 0), best[3]


def scan(crcs: np.ndarray, index: Index, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, end word) of all matches in a text, by place."""
    hits: dict[int, list[tuple[int, int]]] = {}
    wide = crcs.astype(np.uint64)
    if len(index.prints) and len(crcs) >= GRAM:
        hashes = _grams(wide)
        at = winnow(hashes)
        own = hashes[at]
        place = np.minimum(np.searchsorted(index.prints, own), len(index.prints) - 1)
        for k in np.flatnonzero(index.prints[place] == own).tolist():
            for t, q in index.places[int(place[k])]:
                hits.setdefault(t, []).append((int(at[k]), q))
    found: list[tuple[int, int, int, int]] = []
    for t, spots in hits.items():
        size = len(index.words[t])
        groups: list[list[tuple[int, int]]] = []
        for p, q in spots:  # rising p; a new copy of the template starts where q falls back
            if groups and p - groups[-1][-1][0] <= size and q > groups[-1][-1][1]:
                groups[-1].append((p, q))
            else:
                groups.append([(p, q)])
        for group in groups:
            shifts = [p - q for p, q in group]
            slack = BAND + size // 8
            lo = max(0, min(shifts) - slack)
            hi = min(len(crcs), max(shifts) + size + slack)
            text = crcs[lo:hi].tolist()
            matched, first, end = align(index.words[t], text, min(shifts) - slack - lo, max(shifts) + slack - lo)
            if matched >= min_coverage * size:
                found.append((t, matched, lo + first, lo + end))
    if index.short:
        flat = crcs.tolist()
        for t, own in index.short:
            found += [(t, len(own), i, i + len(own)) for i in range(len(flat) - len(own) + 1)
                      if tuple(flat[i:i + len(own)]) == own]
    # The match that covers most words first, then the earlier template.
    kept: list[tuple[int, int, int, int]] = []
    taken: dict[int, int] = {}
    for match in sorted(set(found), key=lambda m: (-m[1], m[0], m[2])):
        if not any(w in taken for w in range(match[2], match[3])):
            kept.append(match)
            taken.update(dict.fromkeys(range(match[2], match[3]), match[0]))
    return sorted(kept, key=lambda m: (m[2], m[0]))


_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
         min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``key`` and matches (license, coverage, start, end) of every row."""
    index = build(TEMPLATES if templates is None else templates)

    def run(batches):
        for batch in slices(batches):
            out = []
            for i, data in enumerate(as_bytes(batch.column(1))):
                crcs = np.array(list(map(zlib.crc32, words(data))), np.uint32)
                matches = scan(crcs, index, min_coverage)
                if matches:
                    spans = [m.span() for m in _WORD.finditer(batch.column(1)[i].as_py())]
                    out.append([{
                        "license": index.names[t], "coverage": matched / len(index.words[t]),
                        "start": spans[first][0], "end": spans[end - 1][1]} for t, matched, first, end in matches])
                else:
                    out.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(_MATCH))], names=["key", "matches"])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(
        run, f"key {kind}, matches array<struct<license: string, coverage: double, start: int, end: int>>"
    ).withColumnRenamed("key", key)


def listed(matches: str = "matches") -> Column:
    """``license:start:end`` of each match, joined by commas."""
    return F.array_join(F.transform(matches, lambda m: F.concat_ws(
        ":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
