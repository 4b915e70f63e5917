"""Personal data: base patterns, and terms that reveal them by corpus co-occurrence.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.
Each distinct value is a protected entity e. The corpus tells how strongly a term t
that stands near it reveals it:

    disclosure(t, e) = PMI(t; e) / IC(e),  IC(e) = ln(N / n(e)),
    PMI(t; e) = ln(N n(t, e) / (n(t) n(e))) = ln(P(e | t) / P(e)),  P(e | t) = n(t, e) / n(t)

the share of what there is to know about e that t gives away. All counts are of
places: a first occurrence and those that begin within ``WINDOW_WORDS`` words of it are
one, so they do not depend on what stands before. A term is near a mention if it
is one of the ``WINDOW_WORDS`` words on either side. N is the number of places that
the corpus has room for, one in each ``WINDOW_WORDS`` words begun.

Small counts are shrunk and not cut off: P(e | t) is estimated as d / (m + d + ``UNSEEN``)
with d different surroundings that hold the pair (copies of one count once), m places
of t without e, and ``UNSEEN`` more in which t is taken to stand without e. So a pair
seen once has at most half a chance, which reveals an entity where IC(e) is large
and none where it is small. Terms whose estimate is at or above ``GENERALISE`` are
replaced by a class mark, those at or above ``REMOVE`` are taken out, wherever they
stand near the entity. Numbers outside base spans are terms like others.

Term counts cover every document; pair counts only arise where an entity stands.

Defined results: null and empty texts have no spans; repeated rows are rows of
their own and all count; spans are in code points, end exclusive; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprobe.llm.skewed import join_groups
from inkprobe.llm.text import as_bytes, slices, words
from inkprobe.session import materialize

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW_WORDS = 32
UNSEEN = 1.0
GENERALISE = 0.8
REMOVE = 0.95
HELD_TERMS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Looking behind changes no match: a run of digits that fails from its start fails from inside.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 3 or len(part) == 3 and part <= "255"

    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order; kind counts into ``KINDS``."""
    if not text:
        return []
    found = [(lo, 0, hi) for lo, hi in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(lo, 1, hi) for lo, hi in _ips(text)] + [(lo, 2, hi) for lo, hi in _cards(text)]
        if "+" in text:
            found += [(lo, 3, hi) for lo, hi in _phones(text)]
    return sorted(found)


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each place of an entity: the entity, a hash of all words around and the terms near it outside base spans."""
    if not spans:
        return []
    found = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [lo for lo, _ in found], [hi for _, hi in found]
    covered = bytearray(len(found))
    places: dict[str, list[list[tuple[int, int]]]] = {}
    for lo, k, hi in spans:
        first, stop = bisect_right(ends, lo), bisect_left(starts, hi)
        covered[first:stop] = b"\1" * (stop - first)
        own = places.setdefault(f"{KINDS[k]}:{text[lo:hi]}", [])
        if not own or first - own[-1][0][0] > WINDOW_WORDS:
            own.append([])
        own[-1].append((first, stop))
    out = []
    for value in sorted(places):
        for mentions in places[value]:
            around: set[int] = set()
            for first, stop in mentions:
                around.update(range(max(0, first - WINDOW_WORDS), first), range(stop, min(len(found), stop + WINDOW_WORDS)))
            near = sorted(around)
            lowered = {i: text[starts[i]:ends[i]].lower() for i in near}
            out.append({
                "entity": value,
                "around": xxhash.xxh64_intdigest(" ".join(lowered[i] for i in near).encode()) - (1 << 63),
                "terms": [{"term": lowered[i], "lo": starts[i], "hi": ends[i]} for i in near if not covered[i]]})
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CONTEXT = pa.struct([("entity", pa.string()), ("around", pa.int64()), ("terms", pa.list_(
    pa.struct([("term", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])))])
_FOUND = ("spans array<struct<start: int, kind: int, end: int>>, contexts array<struct<entity: string, around: bigint, "
          "terms: array<struct<term: string, lo: int, hi: int>>>>")


def base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored rows: row (a number), key, spans and contexts."""
    def run(batches):
        for batch in slices(batches):
            spans, around = [], []
            for t in batch.column(1).to_pylist():
                own = base_spans(t)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                around.append(contexts(t or "", own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(around, pa.list_(_CONTEXT))],
                names=["key", "spans", "contexts"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {_FOUND}")
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "*"), "pii-base")


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): the places of each term in the corpus; the null term counts those there is room for."""
    def run(batches):
        counts: Counter[bytes] = Counter()
        room = 0

        def flush():
            nonlocal room
            terms = [t.decode("utf-8", "replace") for t in counts]
            out = pa.RecordBatch.from_arrays(
                [pa.array([None, *terms], pa.string()), pa.array([room, *counts.values()], pa.int64())],
                names=["term", "n"])
            counts.clear()
            room = 0
            return out

        for batch in slices(batches):
            for data in as_bytes(batch.column(0)):
                split = words(data)
                if data and not data.isascii():
                    split = [w if w.isascii() else w.decode("utf-8", "replace").lower().encode() for w in split]
                room += -(-len(split) // WINDOW_WORDS)
                begun: dict[bytes, int] = {}
                again = []
                for at, term in enumerate(split):
                    if at - begun.setdefault(term, at) > WINDOW_WORDS:
                        begun[term] = at
                        again.append(term)
                counts.update(begun.keys())
                counts.update(again)
            if len(counts) > HELD_TERMS:
                yield flush()
        yield flush()

    partial = docs.select(F.col(text).alias("text")).mapInArrow(run, "term string, n bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(found: DataFrame, docs: DataFrame, text: str = "text", threshold: float = GENERALISE,
               unseen: float = UNSEEN) -> DataFrame:
    """Stored (entity, term, n_te, disclosure, estimate) of all pairs whose estimate is at or above ``threshold``."""
    held = found.select(F.explode("contexts").alias("c")).select(
        F.col("c.entity").alias("entity"), F.col("c.around").alias("around"),
        F.array_distinct(F.col("c.terms.term")).alias("terms"))
    entities = materialize(held.groupBy("entity").agg(
        F.count("*").alias("n_e"), F.sum(F.size("terms")).alias("listed")), "pii-entities")
    pairs = materialize(
        held.select("entity", "around", F.explode("terms").alias("term"))
        .groupBy("entity", "term", "around").agg(F.count("*").alias("n"))
        .groupBy("entity", "term").agg(F.count("*").alias("d"), F.sum("n").alias("n_te")), "pii-pairs")
    counts = materialize(term_counts(docs, text), "term-counts")
    total = float(counts.filter("term IS NULL").agg(F.sum("n")).first()[0] or 1)
    # Only terms near entities are looked up; a term near many of them stays where it is.
    near = pairs.groupBy("term").agg(F.count("*").alias("n_pairs"))
    near = materialize(near.join(counts.withColumnRenamed("n", "n_t"), "term"), "pii-near")
    rows = join_groups(pairs, near, "term", "n_pairs")
    # A term between two places of its entity is near both.
    n_te = F.least("n_te", "n_t")
    chance = F.col("d") / (F.col("n_t") - n_te + F.col("d") + F.lit(unseen))
    rows = rows.select("entity", "term", n_te.alias("n_te"), "n_t", F.log(chance).alias("ln_chance"))
    # What can't reach the threshold even with an entity of one place needs no further look.
    rows = materialize(rows.filter(F.col("ln_chance") >= (threshold - 1) * math.log(total) - 1e-6), "pii-rare")
    rows = join_groups(rows, entities, "entity", "listed")
    ic = F.log(F.lit(total) / F.col("n_e"))
    pmi = F.log(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = lambda value: F.when(ic > 0, value / ic).otherwise(F.lit(0.0))
    scored = rows.select("entity", "term", "n_te", share(pmi).alias("disclosure"),
                         share(F.col("ln_chance") + ic).alias("estimate")).filter(F.col("estimate") >= threshold)
    return materialize(scored, "disclosing")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = GENERALISE,
         unseen: float = UNSEEN) -> DataFrame:
    """``key``, base (spans), spans (all, with terms) and removed (starts of terms to take out)."""
    found = base(docs, key, text)
    strong = disclosing(found, docs, text, threshold, unseen).select(
        F.struct("entity", "term").alias("pair"), "n_te", "estimate")
    placed = found.select("row", F.explode("contexts").alias("c")).select(
        "row", F.col("c.entity").alias("entity"), F.explode("c.terms").alias("t")).select(
        "row", F.struct("entity", F.col("t.term").alias("term")).alias("pair"),
        F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"))
    marks = join_groups(placed, strong, "pair", "n_te").groupBy("row", "lo", "hi").agg(
        F.max("estimate").alias("estimate"))
    marks = marks.groupBy("row").agg(
        F.collect_list(F.struct(F.col("lo").alias("start"), F.lit(KINDS.index("term")).alias("kind"),
                                F.col("hi").alias("end"))).alias("terms"),
        F.collect_list(F.when(F.col("estimate") >= REMOVE, F.col("lo"))).alias("removed"))
    marked = found.select("row", "key", "spans").join(materialize(marks, "pii-terms"), "row", "left")
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return marked.select(
        F.col("key").alias(key), F.col("spans").alias("base"),
        F.array_sort(F.concat("spans", F.coalesce("terms", none))).alias("spans"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redacted(text: str, spans: list[tuple[int, int, int]], removed: set[int]) -> str:
    """``text`` with base spans and generalised terms as class marks, and removed terms gone."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start < at:  # inside or over a span before it: its rest goes with that
            at = max(at, end)
            continue
        out.append(text[at:start])
        if not (KINDS[kind] == "term" and start in removed):
            out.append(f"[{KINDS[kind].upper()}]")
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, found: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and sanitised text of every row, one row each.

    Rows are told apart by a stored number, so null and repeated keys do no harm.
    ``found``, what :func:`find` said of the same rows, saves the search; its keys must
    then be unique, one null key included.
    """
    def run(batches):
        for batch in slices(batches):
            out = []
            for t, spans, removed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                places = [(s["start"], s["kind"], s["end"]) for s in spans or []]
                out.append(None if t is None else redacted(t, places, set(removed or [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    if found is None:
        rows = materialize(rows.select("*", F.monotonically_increasing_id().alias("number")), "numbered")
        spans = find(rows.select(F.col("number").alias("_of"), "text"), "_of", "text")
        same = F.col("number") == F.col("_of")
    else:
        spans = found.withColumnRenamed(key, "_of")
        same = F.col("key").eqNullSafe(F.col("_of"))
    joined = rows.join(spans.select("_of", "spans", "removed"), same, "left")
    return joined.select("key", "text", "spans", "removed").mapInArrow(
        run, f"key {kind}, text string").withColumnRenamed("key", key)
