"""Token ids in a binary file format of patched frame-of-reference blocks.

Documents are ordered by key over range partitions. Each partition becomes one
file: blocks of ``BLOCK_IDS`` ids, then an index of block starts, then the token
count of each document. A block subtracts its smallest id, packs the rest at the
bit width that holds ``PERCENTILE`` per cent of them, and stores the ids that need
more bits in a list of exceptions (place, value). Tasks write through pyarrow's
file systems, to a name of their own each time they run; the stored manifest of
committed tasks says which files count.

Layout, little-endian: magic, block heads and bodies, index (start of each block,
uint64), document counts (uint32), then a footer of blocks, documents, ids, the
two offsets and the magic.

Ids come from the tokenizers library, which sees each distinct blank-separated
part of a batch once: its splitting never joins characters on both sides of one
space between two characters that are not white space. Texts where a part is
empty or begins or ends in white space are encoded whole.

Defined results: a null text is encoded as an empty one and has the end id alone;
equal keys follow each other; repeated rows are documents of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprobe.session import materialize, run_folder, shared_dir

BLOCK_IDS = 8_192
PERCENTILE = 95
END_ID = 2
MAX_READERS = 10_000
MEMO_PARTS = 1_200_000  # parts that a worker remembers
PIECE_BYTES = 8 << 20  # of text encoded at a time
MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<IIBI")  # ids, smallest, width, exceptions
_FOOT = struct.Struct("<QQQQQ8s")  # blocks, documents, ids, index offset, counts offset, magic


# ------------------------------------------------------------------- blocks

def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, least significant first."""
    octets = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(octets, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(
            np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint32)
    low = int(ids.min())
    rest = ids - np.uint32(low)
    at = min(len(rest) - 1, len(rest) * PERCENTILE // 100)
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return b"".join([
        _HEAD.pack(len(ids), low, width, len(odd)), pack(rest, width),
        odd.astype("<u4").tobytes(), rest[odd].astype("<u4").tobytes()])


def decode_block(data: bytes) -> np.ndarray:
    n, low, width, n_odd = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (n * width + 7) // 8
    rest = unpack(data[at:at + size], width, n)
    at += size
    odd = np.frombuffer(data, "<u4", n_odd, at)
    rest[odd] = np.frombuffer(data, "<u4", n_odd, at + 4 * n_odd)
    return rest + np.uint32(low)


class FileWriter:
    """Streams ids into blocks and closes with the index and the document counts."""

    def __init__(self, out):
        self.out, self.at, self.starts, self.counts = out, 0, [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self._put(encode_block(ids))

    def document(self, ids: np.ndarray) -> None:
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            flat = np.concatenate(self.held)
            full = self.n_held - self.n_held % BLOCK_IDS
            for i in range(0, full, BLOCK_IDS):
                self._block(flat[i:i + BLOCK_IDS])
            self.held, self.n_held = [flat[full:]], self.n_held - full

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        counts = self.at
        self._put(np.array(self.counts, "<u4").tobytes())
        self._put(_FOOT.pack(len(self.starts), len(self.counts), self.n_ids, index, counts, MAGIC))


def read_documents(source) -> Iterator[np.ndarray]:
    """The ids of each document, in order, from an open seekable file; holds one block and one document."""
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - _FOOT.size)
    n_blocks, n_docs, _, index, counts_at, magic = _FOOT.unpack(source.read(_FOOT.size))
    if magic != MAGIC:
        raise ValueError("not a token id file")
    source.seek(index)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8").tolist() + [index]
    source.seek(counts_at)
    counts = np.frombuffer(source.read(4 * n_docs), "<u4").tolist()
    block, left = 0, np.zeros(0, np.uint32)
    for n in counts:
        parts, need = [], n
        while need:
            if not len(left):
                source.seek(starts[block])
                left = decode_block(source.read(starts[block + 1] - starts[block]))
                block += 1
            parts.append(left[:need])
            need -= len(parts[-1])
            left = left[len(parts[-1]):]
        yield np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_document(source, number: int) -> np.ndarray:
    """One document by its place in the file, reading only the blocks it touches."""
    source.seek(0, 2)
    source.seek(source.tell() - _FOOT.size)
    n_blocks, n_docs, _, index, counts_at, _ = _FOOT.unpack(source.read(_FOOT.size))
    source.seek(counts_at)
    counts = np.frombuffer(source.read(4 * n_docs), "<u4").astype(np.int64)
    lo = int(counts[:number].sum())
    hi = lo + int(counts[number])
    source.seek(index)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8").tolist() + [index]
    found = []
    for b in range(lo // BLOCK_IDS, -(-hi // BLOCK_IDS)):
        source.seek(starts[b])
        ids = decode_block(source.read(starts[b + 1] - starts[b]))
        found.append(ids[max(0, lo - b * BLOCK_IDS):hi - b * BLOCK_IDS])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


# ---------------------------------------------------------------- tokenizing

class Encoder:
    """Byte-level BPE ids of whole texts; each distinct part is encoded once and then copied by columns."""

    def __init__(self, definition: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition.decode("utf-8"))
        self.model.encode_special_tokens = True
        blank = [i for t, i in self.model.get_vocab().items() if t.startswith("Ġ")]
        self.opens = np.zeros(self.model.get_vocab_size(), bool)
        self.opens[blank] = True
        self.dtype = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        # Place of each part, after a blank or at the start of a text, in the arrays below.
        self.places: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.n = self.used = 0
        self.lengths = np.zeros(1 << 16, np.int64)  # -1: cutting there isn't safe
        self.starts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, self.dtype)

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add parts of the given lengths, whose ids follow each other."""
        while self.n + len(lengths) > len(self.lengths):
            self.lengths, self.starts = np.resize(self.lengths, 2 * self.n), np.resize(self.starts, 2 * self.n)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        sizes = np.maximum(lengths, 0)
        self.lengths[self.n:self.n + len(lengths)] = lengths
        self.starts[self.n:self.n + len(lengths)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.n, self.used = self.n + len(lengths), self.used + len(ids)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Ids of " " + part for new parts, or that cutting there isn't safe."""
        unsafe = [p for p in parts if not p or p[0].isspace() or p[-1].isspace()]
        if unsafe:
            bad = set(unsafe)
            parts = [p for p in parts if p not in bad]
            self.places.update(zip(unsafe, range(self.n, self.n + len(unsafe))))
            self._store(np.zeros(0, self.dtype), np.full(len(unsafe), -1))
        for i in range(0, len(parts), 1_000):
            some = parts[i:i + 1_000]
            ids = self.whole([" " + " ".join(some)])[0]
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(some):
                lengths = np.diff(np.append(cuts, len(ids)))
            else:  # a part holds an unusual blank: take these one by one
                each = self.whole([" " + p for p in some])
                ids, lengths = np.concatenate(each), np.array([len(e) for e in each])
            self.places.update(zip(some, range(self.n, self.n + len(some))))
            self._store(ids, lengths)

    def _learn_heads(self, heads: list[str]) -> None:
        each = self.whole(heads)
        self.heads.update(zip(heads, range(self.n, self.n + len(heads))))
        self._store(np.concatenate(each) if each else np.zeros(0, self.dtype),
                    np.array([len(e) for e in each], np.int64))

    def _looked_up(self, column: pa.Array, known: dict[str, int], learn) -> np.ndarray:
        """Place of every part, by way of the distinct ones."""
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        places = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        if len(new):
            unknown = [distinct[i] for i in new.tolist()]
            learn(unknown)
            places[new] = [known[p] for p in unknown]
        return places[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        if self.n > MEMO_PARTS:
            self._forget()
        split = pc.split_pattern(texts, " ")
        parts, counts = split.flatten(), split.value_lengths().to_numpy()
        ends = np.cumsum(counts)
        first = ends - counts
        places = self._looked_up(parts, self.places, self._learn)
        single = counts == 1
        heads = parts.take(pa.array(first))
        head_places = self._looked_up(heads, self.heads, self._learn_heads)
        # A first part that ends in a blank, or is one, joins what follows.
        bad_head = (self.lengths[places[first]] < 0) & ~single
        places[first] = head_places
        lengths = self.lengths[places]
        odd = (np.minimum.reduceat(lengths, first) < 0) | bad_head
        sizes = np.maximum(lengths, 0)
        stops = np.cumsum(sizes)
        # One gather copies the ids of all parts one after the other.
        at = np.repeat(self.starts[places] - (stops - sizes), sizes)
        at += np.arange(len(at))
        flat = self.ids[at]
        stops = stops[ends - 1]
        out = [flat[a:b] for a, b in zip(np.append(0, stops[:-1]).tolist(), stops.tolist())]
        some = np.flatnonzero(odd).tolist()
        for i, ids in zip(some, self.whole(texts.take(pa.array(some)).to_pylist()) if some else ()):
            out[i] = ids
        return out


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(definition: bytes) -> Encoder:
    """This worker's encoder; what it has learned serves later tasks as well."""
    name = hashlib.sha256(definition).digest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(definition)
    return _ENCODERS[name]


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches (key, text) into pieces of about ``most`` bytes of text; a longer text is one by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


# ------------------------------------------------------------------- on Spark

def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named as Spark names it."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
          end_id: int = END_ID) -> DataFrame:
    """Write id files in ascending key order; the stored manifest: part, path, n_docs, n_ids, base, key.

    ``base`` counts the ids of all files before; ``key`` is null and carries the keys' type.
    The tokenizer's file is read here and its content sent along.
    """
    folder = run_folder(docs.sparkSession, "ids")
    with open(tokenizer_path, "rb") as source:
        definition = docs.sparkSession.sparkContext.broadcast(source.read())

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/ids-{part:05d}-{uuid.uuid4().hex}.bin"
        keys_name = name.replace(".bin", ".keys")
        encoder = None
        n_docs = n_ids = 0
        for batch in pieces(batches):
            if encoder is None:
                encoder = encoder_of(definition.value)
                out, keys_out = system.open_output_stream(name), system.open_output_stream(keys_name)
                writer, keys_file = FileWriter(out), pa.ipc.new_stream(keys_out, batch.select([0]).schema)
            for ids in encoder.encode(pc.fill_null(batch.column(1), "")):
                writer.document(np.append(ids, np.uint32(end_id)).astype(np.uint32))
            keys_file.write_batch(batch.select([0]))
            n_docs += batch.num_rows
        if encoder is not None:
            writer.close()
            out.close()
            keys_file.close()
            keys_out.close()
            n_ids = writer.n_ids
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": name, "keys_path": keys_name, "n_docs": n_docs, "n_ids": n_ids}])

    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # The text's hash lets equal keys spread over partitions.
    ordered = named.withColumn("_h", F.xxhash64("text")).repartitionByRange("key", "_h").sortWithinPartitions(
        "key", "_h").select("key", "text")
    made = materialize(ordered.mapInArrow(
        run, "part bigint, path string, keys_path string, n_docs bigint, n_ids bigint"), "id-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn(
        "key", F.lit(None).cast(docs.select(F.col(f"`{key}`")).schema[0].dataType))


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read the files back: ``key``, start, n_tokens, ids_crc32 (ids as little-endian uint32)."""
    folder = shared_dir(manifest.sparkSession)
    key_type = manifest.schema["key"].dataType.simpleString()

    def run(batches):
        system, _ = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["base"]
                with system.open_input_file(row["path"]) as ids_file, \
                        system.open_input_stream(row["keys_path"]) as keys_file:
                    documents = read_documents(ids_file)
                    for keys in pa.ipc.open_stream(keys_file):
                        starts, counts, sums = [], [], []
                        for _ in range(keys.num_rows):
                            ids = next(documents)
                            starts.append(start)
                            counts.append(len(ids))
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [keys.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()),
                             pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "path", "keys_path", "base")
    # A fixed number keeps adaptive execution from merging the few manifest rows into one task.
    spread = files.repartition(max(1, min(manifest.count(), MAX_READERS)), "part")
    return spread.mapInArrow(
        run, f"key {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)
