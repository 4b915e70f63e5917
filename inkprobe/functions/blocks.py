"""Lookups of whole arrays: blocks of rows ask for each of their distinct keys once.

Rows hold arrays of keys, such as the words of a document. They are dealt into
blocks of bounded size; a block's distinct keys are counted off before they meet the table in
one shuffle, and the answers go back to the block, whose arrays are filled there. So neither
side of any join holds a key more often than there are blocks and scan tasks that read one, and positions
keep their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe.session import materialize, small

BLOCK = "_block"
BLOCK_BYTES = 6 << 20  # of text, about a million words
HELD_KEYS = 2_000_000  # distinct keys a task counts off at a time
SENT_KEYS = 1 << 16  # of a batch
SLICE = 1 << 18  # entries worked on at a time


@dataclass(frozen=True)
class Find:
    """Look the entries of the array ``keys`` up in ``table``, unique on ``key``.

    ``values`` names the columns of ``table`` to add, and the array column each becomes. With
    ``pairs`` the keys are not the entries, whole numbers, but each entry with the one before it (:func:`pair_key`).
    Several arrays that share their keys ask once, and each gets its answers in columns that end with its name.
    """

    keys: str | tuple[str, ...]
    table: DataFrame
    key: str
    values: dict[str, str]
    pairs: bool = False


def _arrays(find: Find) -> dict[str, list[str]]:
    """The key arrays and the columns that each of them adds."""
    if isinstance(find.keys, str):
        return {find.keys: list(find.values.values())}
    return {k: [f"{out}{k}" for out in find.values.values()] for k in find.keys}


def pair_key(first: Column, second: Column) -> Column:
    """A pair of ids as one number."""
    return F.shiftleft(first.cast("bigint"), 32).bitwiseOR(second.cast("bigint"))


def flat_of(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the rows of a list column, from 0, and all its entries."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten()


def sliced(batch: pa.RecordBatch | pa.Table, column: str | int, most: int | None = None) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with at most ``most`` entries of a list column, or of one row; nothing is copied.

    What is worked out of a run takes a multiple of its entries, so a batch or block is never worked on as a whole.
    """
    most = most or SLICE
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def whole_numbers(flat: pa.Array) -> np.ndarray:
    """Entries as numbers; -1 for NULL."""
    return pc.fill_null(flat.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)


def _keys(lists: pa.Array, pairs: bool) -> tuple[np.ndarray, pa.Array]:
    offsets, flat = flat_of(lists)
    if not pairs:
        return offsets, flat
    ids = whole_numbers(flat)
    none = np.zeros(len(ids), bool)
    none[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    before = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
    return offsets, pa.array((before << 32) | ids, pa.int64(), mask=none)


def of_lists(offsets: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of equal values."""
    if len(values):
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def repeated(rows: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """The values of ``by``, NULL included, that several rows hold, stored; None where there are none."""
    found = materialize(rows.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").select(*by), "repeated")
    return None if found.isEmpty() else found


def with_keys(rows: DataFrame, keys: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Rows whose ``by`` is (``left_semi``) or is not (``left_anti``) among ``keys``; NULL equals NULL."""
    named = keys.select(*[F.col(c).alias(f"_is_{c}") for c in by])
    return rows.join(small(named, named.count()), reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_is_{c}")) for c in by]), how)


def _distinct(batches: Iterable[pa.RecordBatch], pairs: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Block and key of the distinct keys; a block's rows lie together, as they were stored."""
    held: dict[int, list[pa.Array]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for block, parts in held.items():
            keys = pc.unique(pa.concat_arrays(parts)) if len(parts) > 1 else parts[0]
            for at in range(0, len(keys), SENT_KEYS):
                part = keys.slice(at, SENT_KEYS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block, np.int64)), part], names=[BLOCK, "_key"])

    for batch in batches:
        for start, stop in runs(batch.column(0).to_numpy(zero_copy_only=False)):
            for own in sliced(batch.slice(start, stop - start), 1):
                asked = [_keys(c, pairs)[1].cast(kind) for c in own.columns[1:]]
                found = pc.unique(pa.concat_arrays(asked) if len(asked) > 1 else asked[0]).drop_null()
                held.setdefault(own.column(0)[0].as_py(), []).append(found)
                size += len(found)
                if size > HELD_KEYS:
                    held = {b: [pc.unique(pa.concat_arrays(p))] for b, p in held.items()}
                    size = sum(len(p[0]) for p in held.values())
                    if size > HELD_KEYS // 2:
                        yield from sent()
                        held, size = {}, 0
    yield from sent()


def store_blocks(rows: DataFrame, size: Column, columns: Sequence[Column | str], name: str,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``columns`` of the rows and their ``_block``, stored; ``size`` gives a row's bytes.

    A scan task deals its rows in turn to as many blocks as the measured size asks for.
    """
    part = F.spark_partition_id()
    facts = rows.select(size.cast("bigint").alias("size"), part.alias("part")).agg(
        F.sum("size").alias("size"), F.countDistinct("part").alias("parts")).first()
    each = max(1, -(-(facts["size"] or 0) // (max(1, facts["parts"]) * block_bytes)))
    block = part.cast("bigint") * each + F.pmod(F.monotonically_increasing_id(), F.lit(each))
    return materialize(rows.select(block.alias(BLOCK), *columns), name)


def _filled(left: pa.Table, right: pa.Table, finds: Sequence[tuple[dict[str, list[str]], bool]],
            slots: Sequence[Sequence[str]]) -> Iterator[pa.Table]:
    """Runs of a block's rows with what they ask for; ``slots`` names the columns of the answers to each find."""
    places, answers = {}, []
    for i, (arrays, pairs) in enumerate(finds):
        own = right.select(["_key", *slots[i]]).filter(pc.equal(right.column("_find"), i))
        keyed = _one(own.column("_key"))
        answers.append([_one(own.column(c)) for c in slots[i]])
        for keys in arrays:
            asked = [_keys(part.column(keys), pairs)[1].cast(keyed.type) for part in sliced(left, keys)]
            # A chunk for each part, so the keys are hashed once and the parts looked up one by one.
            places[i, keys] = _one(pc.index_in(pa.chunked_array(asked, keyed.type), value_set=keyed))
        del asked, own, keyed
    done = dict.fromkeys(places, 0)
    first = next(iter(finds[0][0]))
    for part in sliced(left, first):
        out = {c: part.column(c) for c in part.column_names}
        for i, (arrays, _) in enumerate(finds):
            for keys, values in arrays.items():
                offsets, _ = flat_of(part.column(keys))
                at = places[i, keys].slice(done[i, keys], int(offsets[-1]))
                done[i, keys] += int(offsets[-1])
                for found, name in zip(answers[i], values):
                    out[name] = of_lists(offsets, found.take(at))
        yield pa.table(list(out.values()), names=list(out))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        return pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)
    return whole


def look_up(rows: DataFrame, finds: Iterable[Find], drop: Sequence[str] = (),
            finish: Callable[[pa.Table], dict[str, pa.Array]] | None = None,
            finished: T.StructType | None = None,
            turn: tuple[Callable[[pa.Table], pa.Table], T.StructType] | None = None) -> DataFrame:
    """Add the arrays that ``finds`` name to ``rows`` of :func:`store_blocks`; entries not found are NULL.

    ``rows`` are read once more for each find, so they should be stored. Keys of all finds have one type, text or
    whole numbers. ``finish`` turns runs of a block's filled rows into the columns ``finished``, which then are added instead.
    ``turn`` makes other rows of them, and names the columns of these.
    """
    finds = list(finds)
    text = {rows.schema[k].dataType.elementType.typeName() == "string" for f in finds for k in _arrays(f)}
    if len(text) > 1:
        raise ValueError("keys of one look-up must have one type")
    kind, plain = ("string", pa.string()) if text.pop() else ("bigint", pa.int64())
    answers, added, slots = [], [], []
    for i, f in enumerate(finds):
        asked = rows.select(BLOCK, *_arrays(f)).mapInArrow(
            lambda batches, pairs=f.pairs: _distinct(batches, pairs, plain), f"{BLOCK} bigint, _key {kind}")
        # Answers to all finds share their columns, of which each type has as many as one find needs.
        types = [f.table.schema[v].dataType.simpleString() for v in f.values]
        own = [f"_v{types[:j].count(t)}_{t}" for j, t in enumerate(types)]
        known = f.table.select(F.col(f.key).cast(kind).alias("_key"), *[F.col(v).alias(c) for v, c in zip(f.values, own)])
        answers.append(asked.join(known, "_key").select(F.col(BLOCK).alias("_to"), F.lit(i).alias("_find"), "_key", *[
            F.col(f"`{c}`") for c in own]))
        slots.append(own)
        added += [T.StructField(out, T.ArrayType(f.table.schema[v].dataType))
                  for outs in _arrays(f).values() for v, out in zip(f.values, outs)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), answers)
    schema = T.StructType([f for f in rows.schema if f.name not in drop] + (
        added if finish is None else list(finished)))
    wanted = [(_arrays(f), f.pairs) for f in finds]
    names = schema.names

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for found in _filled(left, right, wanted, slots):
            made = {} if finish is None else finish(found)
            part = pa.table([made[c] if c in made else found.column(c) for c in names], names=names)
            parts.append(part if turn is None else turn[0](part))
        return pa.concat_tables(parts)

    return rows.groupBy(BLOCK).cogroup(every.groupBy("_to")).applyInArrow(fill, schema if turn is None else turn[1])
