"""Tokens, vocabularies, windows and token counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprobe import params
from inkprobe.functions.blocks import BLOCK, Find, flat_of, look_up, of_lists, repeated, store_blocks, with_keys
from inkprobe.session import materialize

START_CHARS = 3
BLOCK_TOKENS = 1_200_000
TASK_BLOCKS = 1 << 20
LIST_WORDS = 4_096  # of a stored row
WORD_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def words(text: Column | str) -> Column:
    """Runs of letters or digits, and every other visible sign on its own."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_table(docs: DataFrame, keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """One row per word with its neighbours; narrow, no shuffle.

    ``prev_word`` is '' at the start and ``next_word`` NULL at the end of a document.
    """
    split = docs.select("doc_id", *keep, words(text).alias("_w"))
    shifted = F.concat(F.array(F.lit("")), F.col("_w"))
    following = F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1)))
    zipped = F.arrays_zip(
        F.col("_w").alias("word"), shifted.alias("prev_word"), following.alias("next_word"))
    rows = split.select(
        "doc_id", *keep, F.size("_w").alias("n_tokens"), F.posexplode(zipped).alias("pos", "_t"))
    rows = rows.select("doc_id", *keep, "n_tokens", "pos", "_t.word", "_t.prev_word", "_t.next_word")
    return rows.filter(F.col("word").isNotNull())  # the shifted array is one longer


def build_vocab(docs: DataFrame, size: int | None = None) -> DataFrame:
    """Vocabulary ``(token, token_id, n)``; the most frequent words get the lowest ids.

    All words count unless ``size`` caps them, reserved ids included, as a
    pretrained tokenizer's does. Numbers are given inside groups of one count and
    one word start, so the many words seen once are not numbered by one task.
    """
    return number_words(word_table(docs).groupBy(F.col("word").alias("token")).agg(F.count("*").alias("n")), size)


def number_words(counts: DataFrame, size: int | None = None) -> DataFrame:
    """:func:`build_vocab` of counted words ``(token, n)``."""
    if size is None:
        from inkprobe.functions.ordering import running_totals
        counts = materialize(counts, "word_counts").withColumn("_p", F.substring("token", 1, START_CHARS))
        per = counts.groupBy("n", "_p").agg(F.count("*").alias("types"))
        line = W.partitionBy("n").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
        within = per.select("n", "_p", F.coalesce(F.sum("types").over(line), F.lit(0)).alias("_within"))
        starts = running_totals(per.groupBy("n").agg(F.sum("types").alias("types")), "n", ["types"],
                                descending=True).select("n", (F.col("cum_types") - F.col("types")).alias("_before"))
        inside = W.partitionBy("n", "_p").orderBy("token")
        ranked = counts.join(within.join(starts, "n"), ["n", "_p"]).withColumn(
            "_r", F.row_number().over(inside) + F.col("_within") + F.col("_before"))
        return ranked.select(
            "token", (F.col("_r") + (params.N_RESERVED - 1)).cast("int").alias("token_id"), "n")
    best = [F.desc("n"), F.asc("token")]
    room = size - params.N_RESERVED
    band = F.floor(F.log2("n") * 16).cast("int")
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("types"))
    reach = F.sum("types").over(W.orderBy(F.desc("band")))
    cut = bands.select("band", reach.alias("reach")).agg(
        F.coalesce(F.max(F.when(F.col("reach") >= room, F.col("band"))), F.lit(0))).scalar()
    top = counts.filter(band >= cut).orderBy(*best).limit(room)
    return top.select(
        "token",
        (F.row_number().over(W.orderBy(*best)) + (params.N_RESERVED - 1)).alias("token_id"), "n")


def fits(vocab: DataFrame) -> bool:
    """Whether a (stored) vocabulary is small enough to broadcast, as measured in rows and bytes."""
    size = vocab.agg(F.count("*").alias("n"), F.coalesce(
        F.sum(F.octet_length("token") + 48), F.lit(0)).alias("bytes")).first()
    return size["n"] <= params.MAX_BROADCAST_ROWS and size["bytes"] <= params.MAX_BROADCAST_BYTES


def _coded(batches: Iterable[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Documents with the words of their block as numbers, and the words and counts of each block."""
    first = TaskContext.get().partitionId() * TASK_BLOCKS
    held, size, n = [], 0, 0

    def block() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        offsets, flat = flat_of(table.column("words"))
        coded = flat.dictionary_encode()
        known, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(codes, minlength=len(known)).astype(np.int64)
        rest = table.drop_columns(["words"])
        name = lambda rows: pa.array(np.full(rows, first + n, np.int64))
        # Cut by rows: lists of one batch are bounded by what came in.
        documents = pa.table([name(len(table)), *rest.columns, of_lists(offsets, pa.array(codes, pa.int32())),
                              pa.nulls(len(table), pa.int32()), pa.nulls(len(table), pa.list_(pa.string())),
                              pa.nulls(len(table), pa.list_(pa.int64()))],
                             names=[BLOCK, *rest.column_names, "codes", "first", "words", "counts"])
        yield from documents.combine_chunks().to_batches()
        starts = np.arange(0, len(known), LIST_WORDS)
        ends = np.append(starts, len(known))
        yield pa.RecordBatch.from_arrays(
            [name(len(starts)), *[pa.nulls(len(starts), f.type) for f in rest.schema],
             pa.nulls(len(starts), pa.list_(pa.int32())), pa.array(starts, pa.int32()),
             of_lists(ends, known), of_lists(ends, pa.array(counts))], names=documents.column_names)

    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + block_tokens - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += ends[stop - 1] - before
            start = stop
            if size >= block_tokens or start < batch.num_rows:
                yield from block()
                held, size, n = [], 0, n + 1
    if held:
        yield from block()


def code_words(docs: DataFrame, keep: Sequence[str] = (), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents dealt into blocks, their words as numbers of the block's own word list; stored.

    Rows are documents ``(_block, doc_id, *keep, codes)``, or parts ``(_block, first, words, counts)`` of the
    block's list, whose words have the numbers from ``first`` on. Texts are split once and no word moves.
    """
    listed = F.coalesce(words("text"), F.array().cast("array<string>")).alias("words")
    rows = docs.select("doc_id", *keep, listed)
    schema = T.StructType([T.StructField(BLOCK, T.LongType()), *[
        T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "words"]])
    for name, kind in (("codes", T.ArrayType(T.IntegerType())), ("first", T.IntegerType()),
                       ("words", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    return materialize(rows.mapInArrow(lambda batches: _coded(batches, block_tokens), schema), "coded_words")


def vocab_of(coded: DataFrame, size: int | None = None) -> DataFrame:
    """:func:`build_vocab` of the documents of :func:`code_words`; each block sends a word once."""
    listed = coded.filter(F.col("words").isNotNull()).select(F.explode(F.arrays_zip("words", "counts")).alias("_w"))
    return number_words(listed.groupBy(F.col("_w.words").alias("token")).agg(F.sum("_w.counts").alias("n")), size)


def _with_ids(left: pa.Table, right: pa.Table, names: Sequence[str], finds: dict[str, int]) -> pa.Table:
    offsets, codes = flat_of(left.column("codes"))
    codes = codes.to_numpy(zero_copy_only=False)
    out = {c: left.column(c) for c in names if c in left.column_names}
    for name, i in finds.items():
        own = right.filter(pc.equal(right.column("_find"), i))
        at = own.column("at").to_numpy()
        if name == "words":
            order = pa.array(np.argsort(at))
            out[name] = of_lists(offsets, pc.take(own.column("word"), order).combine_chunks().take(pa.array(codes)))
            continue
        ids = np.full(codes.max(initial=-1) + 1, params.UNK, np.int32)
        ids[at] = own.column("token_id").to_numpy()
        out[name] = of_lists(offsets, pa.array(ids[codes]))
    return pa.table([out[c] for c in names], names=list(names))


def encode_coded(coded: DataFrame, vocab: DataFrame, keep: Sequence[str] = (), lower: bool = False,
                 with_word: bool = False) -> DataFrame:
    """:func:`encode` of the documents of :func:`code_words`; only the blocks' words meet the vocabulary."""
    docs = coded.filter(F.col("words").isNull()).select(BLOCK, "doc_id", *keep, "codes")
    entries = coded.filter(F.col("words").isNotNull()).select(
        F.col(BLOCK).alias("_to"), "first", F.posexplode("words").alias("_i", "word")).select(
        "_to", (F.col("first") + F.col("_i")).alias("at"), "word")
    known = vocab.select(F.col("token").alias("_w"), F.col("token_id").cast("int").alias("token_id"))
    find = lambda i, w: entries.withColumn("_w", w).join(known, "_w").select("_to", F.lit(i).alias("_find"), "at", "token_id")
    answers, finds = find(0, F.col("word")), {"input_ids": 0}
    if lower:
        answers, finds["low_ids"] = answers.unionByName(find(1, F.lower("word"))), 1
    if with_word:
        named = entries.select("_to", F.lit(2).alias("_find"), "at", "word")
        answers, finds["words"] = answers.unionByName(named, allowMissingColumns=True), 2
    schema = T.StructType([f for f in docs.schema if f.name != "codes"])
    for name in finds:
        schema = schema.add(name, T.ArrayType(T.StringType() if name == "words" else T.IntegerType()))
    names = schema.names
    return materialize(docs.groupBy(BLOCK).cogroup(answers.groupBy("_to")).applyInArrow(
        lambda left, right: _with_ids(left, right, names, finds), schema), "corpus")


def encode(docs: DataFrame, vocab: DataFrame, keep: Sequence[str] = (), lower: bool = False,
           with_word: bool = False) -> DataFrame:
    """Documents as arrays, stored in blocks: ``(_block, doc_id, *keep, input_ids)``.

    Each block of documents asks the vocabulary for its distinct words, whatever their
    number. ``lower`` adds ``low_ids``, of the lower-cased words, ``with_word`` the ``words``.
    """
    return encode_coded(code_words(docs, keep), vocab, keep, lower, with_word)


def vocab_and_corpus(docs: DataFrame, keep: Sequence[str] = (), size: int | None = None,
                     **options: bool) -> tuple[DataFrame, DataFrame]:
    """:func:`build_vocab`, stored, and :func:`encode` from one pass over the texts."""
    coded = code_words(docs, keep)
    vocab = materialize(vocab_of(coded, size), "vocab")
    return vocab, encode_coded(coded, vocab, keep, **options)


def token_rows(corpus: DataFrame, keep: Sequence[str] = (), with_next: bool = False,
               extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Long tokens ``(doc_id, *keep, n_tokens, pos, token_id, prev, ...)`` of :func:`encode`; narrow.

    ``low_ids`` and ``words`` give low_id, low_prev and word where they are there;
    ``extra`` names further arrays of one entry a token.
    """
    ids = F.col("input_ids")
    before = lambda c: F.concat(F.array(F.lit(params.BOS)), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))
    cols = {"token_id": ids, "prev": before("input_ids")}
    if with_next:
        cols["next"] = F.concat(F.slice("input_ids", F.lit(2), F.size(ids)), F.array(F.lit(params.EOS)))
    if "low_ids" in corpus.columns:
        cols |= {"low_id": F.col("low_ids"), "low_prev": before("low_ids")}
    if "words" in corpus.columns:
        cols["word"] = F.col("words")
    cols |= extra or {}
    zipped = F.arrays_zip(*[c.alias(name) for name, c in cols.items()])
    filled = corpus.filter(F.size(ids) > 0)
    # Lengths are taken before rows are made: else each row of a document would hold all its tokens.
    packed = filled.select("doc_id", *keep, F.size(ids).alias("n_tokens"), zipped.alias("_z"))
    rows = packed.select("doc_id", *keep, "n_tokens", F.posexplode("_z").alias("pos", "_t"))
    return rows.select("doc_id", *keep, "n_tokens", "pos", *[F.col("_t")[c].alias(c) for c in cols])


def token_table(docs: DataFrame, vocab: DataFrame, keep: Sequence[str] = (),
                with_next: bool = False, with_word: bool = False, lower: bool = False) -> DataFrame:
    """Long tokens ``(doc_id, ..., n_tokens, pos, token_id, prev)`` over the stored :func:`encode`.

    ``lower`` adds the ids of the lower-cased words.
    """
    return token_rows(encode(docs, vocab, keep, lower, with_word), keep, with_next)


def tokenize(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace ``text`` by ``input_ids`` and ``attention_mask``; other columns stay.

    Ids of documents with a token must be unique; a document without id has no tokens.
    """
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    return tokenized(encode(docs, vocab, keep), keep)


def tokenized(corpus: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """:func:`tokenize` of the documents of :func:`encode`; only rows that share their id move."""
    none = F.array().cast("array<int>")

    def rows(docs: DataFrame, ids: Column) -> DataFrame:
        return docs.select("doc_id", *keep, ids.alias("input_ids")).withColumn(
            "attention_mask", F.transform("input_ids", lambda _: F.lit(1)))

    own = F.when(F.col("doc_id").isNotNull(), F.col("input_ids")).otherwise(none)
    shared = repeated(corpus.filter(F.col("doc_id").isNotNull()), ["doc_id"])
    if shared is None:
        return rows(corpus, own)
    several = with_keys(corpus, shared, ["doc_id"], "left_semi")
    found = several.filter(F.size("input_ids") > 0).groupBy("doc_id").agg(
        F.min("input_ids").alias("_ids"), F.count("*").alias("_n"))
    single = F.when(F.col("_n") == 1, F.col("_ids")).otherwise(
        F.raise_error(F.lit("document ids must be unique")).cast("array<int>"))
    joined = several.select("doc_id", *keep).join(found.select("doc_id", single.alias("_ids")), "doc_id", "left")
    return rows(with_keys(corpus, shared, ["doc_id"], "left_anti"), own).unionByName(rows(joined, F.coalesce("_ids", none)))


def explode_ids(corpus: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long tokens from an ``input_ids`` corpus; narrow."""
    ids = F.col("input_ids")
    shifted = F.concat(F.array(F.lit(params.BOS)), ids)
    zipped = F.arrays_zip(ids.alias("token_id"), shifted.alias("prev"))
    rows = corpus.select(
        "doc_id", *keep, F.size(ids).alias("n_tokens"), F.posexplode(zipped).alias("pos", "_t"))
    return rows.select("doc_id", *keep, "n_tokens", "pos", "_t.token_id", "_t.prev").filter(
        F.col("pos") < F.col("n_tokens"))


# ---------------------------------------------------------------- windows

def _begins(n: Column, stride: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(
        F.array().cast("array<int>"))


def sequence_windows(lengths: DataFrame, context: int = params.CONTEXT,
                     stride: int = params.STRIDE) -> DataFrame:
    """Every window start below the length, trailing short windows included."""
    n = F.col("n_tokens")
    rows = lengths.withColumn("begin", F.explode(_begins(n, stride)))
    return rows.withColumn("end", F.least(F.col("begin") + context, n))


def context_windows(lengths: DataFrame, context: int = params.CONTEXT,
                    stride: int = params.STRIDE) -> DataFrame:
    """Windows up to and including the first that reaches the end."""
    rows = sequence_windows(lengths, context, stride)
    begin = F.col("begin")
    return rows.filter((begin == 0) | (begin - stride + context < F.col("n_tokens")))


def doc_lengths(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return docs.select("doc_id", *keep, F.size(words("text")).alias("n_tokens"))


def _first_begin(pos: Column, context: int, stride: int) -> Column:
    """Lowest window start whose window still covers ``pos``."""
    return (F.ceil(F.greatest(pos - (context - 1), F.lit(0)) / F.lit(stride)) * stride).cast("int")


def last_begin(context: int, stride: int) -> Column:
    """Start of a document's last context window."""
    over = F.greatest(F.col("n_tokens") - context, F.lit(0))
    return (F.ceil(over / F.lit(stride)) * stride).cast("int")


def scoring_begin(context: int, stride: int) -> Column:
    """Start of the last window that scores ``pos``; NULL when none does."""
    pos = F.col("pos")
    begin = F.least((F.floor((pos - 1) / F.lit(stride)) * stride).cast("int"),
                    last_begin(context, stride))
    return F.when((pos > 0) & (begin + context > pos), begin)


def slots_of(pos: np.ndarray, n_tokens: np.ndarray, context: int, stride: int) -> np.ndarray:
    """:func:`slot_count` of arrays."""
    last = -(-np.maximum(n_tokens - context, 0) // stride) * stride
    low = -(-np.maximum(pos - (context - 1), 0) // stride)
    return np.where(pos > 0, np.maximum(np.minimum(pos - 1, last) // stride - low + 1, 0), 0)


def is_scored(pos: np.ndarray, n_tokens: np.ndarray, context: int, stride: int) -> np.ndarray:
    """Whether :func:`scoring_begin` has a window, of arrays."""
    last = -(-np.maximum(n_tokens - context, 0) // stride) * stride
    begin = np.minimum((pos - 1) // stride * stride, last)
    return (pos > 0) & (begin + context > pos)


def slot_count(context: int, stride: int) -> Column:
    """Number of context windows that score ``pos``."""
    pos = F.col("pos")
    last = F.least(pos - 1, last_begin(context, stride))
    n = F.floor(last / F.lit(stride)) - _first_begin(pos, context, stride) / F.lit(stride) + 1
    return F.when(pos > 0, F.greatest(n, F.lit(0))).otherwise(F.lit(0)).cast("int")


def total_slots(context: int, stride: int) -> Column:
    """Sum of :func:`slot_count` over a document: full windows, then the last one."""
    n, last = F.col("n_tokens"), last_begin(context, stride)
    return (last / F.lit(stride)).cast("bigint") * (context - 1) + (n - last - 1)


def covering_begins(context: int, stride: int, early_stop: bool = False) -> Column:
    """Starts of the windows that cover ``pos``, as an array; NULL when none does."""
    pos = F.col("pos")
    top = F.floor(pos / F.lit(stride)).cast("int") * stride
    if early_stop:
        top = F.least(top, last_begin(context, stride))
    low = _first_begin(pos, context, stride)
    return F.when(low <= top, F.sequence(low, top, F.lit(stride)))


def explode_windows(tokens: DataFrame, context: int = params.CONTEXT, stride: int = params.STRIDE,
                    early_stop: bool = False) -> DataFrame:
    """One row per token and window that covers it (first position included); narrow."""
    return tokens.withColumn("begin", F.explode(covering_begins(context, stride, early_stop)))


def decode(rows: DataFrame, vocab: DataFrame, by: Sequence[str]) -> DataFrame:
    """Text of each group of tokens in ``pos`` order.

    The groups are formed of ids, a number each; blocks of them then look their words up.
    """
    by = list(by)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda e: e["token_id"])
    packed = rows.groupBy(*by).agg(in_order.alias("_ids"))
    stored = store_blocks(packed, F.size("_ids") * 6, [*by, "_ids"], "id_groups")
    named = look_up(stored, [Find("_ids", vocab, "token_id", {"token": "_words"})])
    return named.select(*by, F.array_join("_words", " ", params.UNK_TEXT).alias("text"))


# ----------------------------------------------------------------- counts

def token_counts(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tokens.groupBy(*by, "token_id").agg(F.count("*").alias("n"))


def merge_counts(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the counts of new documents to an existing count table."""
    keys = [*by, "token_id"]
    both = old.select(*keys, "n").unionByName(new.select(*keys, "n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def token_freq(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each token; totals come from the already aggregated counts."""
    if not by:
        total = counts.agg(F.sum("n")).scalar()
        return counts.withColumn("value", F.col("n") / total)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counts.join(totals, list(by)).withColumn(
        "value", F.col("n") / F.col("_total")).drop("_total")
