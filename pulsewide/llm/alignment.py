"""Cross-tokenizer alignment: groups of two tokenizers' tokens that cover the same bytes.

Of every text, both token lists are laid over the bytes of ``space + text``. Dictionaries
from a token's cumulative end to its place in the list are intersected as sets; the sorted
common ends slice both lists into groups, the finest in which the two agree. In a group of
k and l tokens the links, pairs whose byte ranges overlap, are k + l - 1: each inner end
moves on one side alone. They are expanded group after group from the ends.

A pair of ids is counted over the corpus. Texts are encoded once; ids and group sizes are
written, and later passes read these:

* Pairs are counted task by task in bounded tables, then by key. The pair table is written.
* The ``HOT_PAIRS`` most frequent pairs at most (16 MB) and the highest count of each id of
  the second tokenizer (one number an id) are sent to all tasks. Which pairs these are is read
  from a histogram of at most 64 x ``STEPS`` counts. Links of all other pairs, which are rare
  each, are joined by key, so every count is exact whatever the number of pairs.

The tokenizers' files are read on the driver (some MB) and sent to the tasks.

Defined cases: a text that is null, empty or not given back byte by byte by both token lists
has no tokens, groups or links, and empty digests; special tokens' strings in a text are
text; a very long text is one row of two id lists, encoded alone; repeated rows are texts
of their own, counted each; an empty table gives none. Only the text and the carried
columns are read; a carried column with an output's name gives way to it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.llm.batches import lean, quoted, texts_of
from pulsewide.session import materialise

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
HOT_PAIRS = 1 << 20
#: Steps of the count histogram for each doubling.
STEPS = 16
#: Pairs that a task counts before it passes them on.
TABLE = 1 << 19
_CHUNK_BYTES = 1 << 18
#: Rows that are worked on together.
_ROWS = 256
_SHIFT = 32

#: Written for each text: both id lists as little-endian numbers, the digest and three sizes.
_WRITTEN = T.StructType([
    T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("groups_sha256", T.StringType()),
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
])
GROUP = T.StructType([T.StructField("n_a", T.IntegerType()), T.StructField("n_b", T.IntegerType())])
LISTS = T.StructType([
    T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType())),
    T.StructField("groups", T.ArrayType(GROUP)),
])
NUMBERS = ("groups_sha256", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
OUTPUTS = (*LISTS.names, *NUMBERS)


def _byte_of_character() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, all others,
    in order, for the characters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: Splits a text as the byte-level pre-tokenizer does (fixed value: the published pattern).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts whose characters every version of the Unicode tables classes alike, and of a length
#: for which the pattern needs little memory.
_PLAIN_BELOW, _PLAIN_CHARS = "\u0250", 1 << 17


class ByteBpe:
    """Tokens and their bytes of a byte-level BPE in one JSON file.

    Merging by rank in ``tiktoken`` gives the same tokens in a fifth of the time. It takes
    the plain texts, if the file is a byte-level BPE whose ids follow its merges.
    """

    def __init__(self, file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs tasks side by side
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(file.decode())
        self._tokenizer.encode_special_tokens = True
        value = _byte_of_character()
        entries = self._tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(value[c] for c in entry) if all(c in value for c in entry) else entry.encode()
        self._by_rank = self._ranked(json.loads(file), value)

    @staticmethod
    def _ranked(spec: dict, value: dict[str, int]):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        order = [model["vocab"][a + b] for a, b in merges]
        plain = (
            model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel"
            and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("ignore_merges")
            and not model.get("dropout") and order == sorted(order)
        )
        if not plain:
            return None
        import tiktoken

        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(value[c] for c in entry): i for entry, i in model["vocab"].items() if entry not in special}
        return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self._by_rank is not None and len(t) <= _PLAIN_CHARS and max(t, default="") < _PLAIN_BELOW for t in texts]
        others = [" " + t for t, p in zip(texts, plain) if not p]
        rest = iter(self._tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ())
        return [self._by_rank.encode_ordinary(" " + t) if p else next(rest).ids for t, p in zip(texts, plain)]


class PieceBpe:
    """Tokens and their bytes of a piece model, which puts a space before the text."""

    def __init__(self, file: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = model = SentencePieceProcessor(model_proto=file)
        self.bytes = [
            bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def _reader(path: str) -> type:
    return ByteBpe if path.endswith(".json") else PieceBpe


def common_groups(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[list[int], list[int]]:
    """How many tokens of each list have ended at each end that both have."""
    a = dict(zip(np.cumsum(a_lengths).tolist(), itertools.count(1)))
    b = dict(zip(np.cumsum(b_lengths).tolist(), itertools.count(1)))
    common = sorted(a.keys() & b.keys())
    return [a[e] for e in common], [b[e] for e in common]


class Printer:
    """The text of groups, ``a1,a2|b1;a3|b2,b3``, from ready pieces for every id."""

    def __init__(self, size: int) -> None:
        self._size = size
        self._pieces = np.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], object)

    def text(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        a_kind, b_kind = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_kind[a_ends - 1], b_kind[b_ends - 1] = 1, 2
        a_sizes, b_sizes = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        pieces = np.empty(len(a) + len(b), np.int64)
        pieces[np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)] = a + a_kind * self._size
        pieces[np.arange(len(b)) + np.repeat(a_ends, b_sizes)] = b + b_kind * self._size
        return "".join(self._pieces[pieces].tolist())[:-1]


def _int_lists(lists: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, lists)], dtype=np.int32), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *lists]), pa.int32()))


def _files(docs: DataFrame, paths: Sequence[str]):
    files = []
    for path in paths:
        with open(path, "rb") as f:
            files.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(files)


def _encoded(docs: DataFrame, text: str, files, readers: Sequence[type], carry: Sequence[str]) -> DataFrame:
    """Both id lists, the digest of the groups and the numbers of tokens and groups of every text."""
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)], *_WRITTEN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        first, second = (reader(file) for reader, file in zip(readers, files.value))
        a_len, b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (first, second))
        printer = Printer(max(len(a_len), len(b_len)))
        kinds = [_width(len(t.bytes)) for t in (first, second)]

        def aligned(raw: bytes, a: list[int], b: list[int]) -> tuple:
            whole = b" " + raw
            if b"".join([first.bytes[i] for i in a]) != whole or b"".join([second.bytes[i] for i in b]) != whole:
                return _NOTHING
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            a_ends, b_ends = (np.array(x, np.int64) for x in common_groups(a_len[a], b_len[b]))
            digest = hashlib.sha256(printer.text(a, b, a_ends, b_ends).encode()).hexdigest()
            return a.astype(kinds[0]).tobytes(), b.astype(kinds[1]).tobytes(), digest, len(a), len(b), len(a_ends)

        def chunk(texts: list[bytes]) -> Iterator[tuple]:
            plain = [t.decode("utf-8", "replace") for t in texts]
            return map(aligned, texts, first.encode(plain), second.encode(plain))

        def rows(texts: list[bytes | None]) -> list[tuple]:
            out, held, size = [], [], 0
            for t in texts:
                if t:
                    held.append(t)
                    size += len(t)
                if not t or size >= _CHUNK_BYTES:
                    out.extend(chunk(held))
                    held, size = [], 0
                if not t:
                    out.append(_NOTHING)
            out.extend(chunk(held))
            return out

        for batch in batches:
            for b in _slices(batch):
                made = list(zip(*rows(list(texts_of(b.column(len(carry)))))))
                kinds_of = (pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: len(carry)], *[pa.array(c, k) for c, k in zip(made, kinds_of)]], names=schema.names)

    sent = [quoted(c).alias(f"c{i}") for i, c in enumerate(carry)]
    return docs.select(*sent, quoted(text).cast("string").alias("t")).mapInArrow(run, schema)


_NOTHING = (b"", b"", "", 0, 0, 0)


def _width(size: int) -> str:
    """The narrowest number that holds every id."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of id lists, and how many each row has."""
    lists = column.to_pylist()
    sizes = np.array([len(x) for x in lists], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(lists), kind).astype(np.int64), sizes


def links(a: pa.Array, b: pa.Array, lengths: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch as ``a << 32 | b``, and the row of each. The two lists of a row
    have the same bytes, so rows can be laid end to end: each end closes a stretch of bytes
    that one token of either list covers."""
    (a, n_a), (b, _) = (_ids(c, _width(len(size))) for c, size in zip((a, b), lengths))
    ends = [np.cumsum(size[ids]) for size, ids in zip(lengths, (a, b))]
    if not len(a):
        return a, a
    marks = np.zeros((2, ends[0][-1] + 1), bool)
    marks[0, ends[0]] = marks[1, ends[1]] = True
    closed = np.flatnonzero(marks[0] | marks[1])
    # the token that covers the stretch is the one after all that have ended before
    first, second = (np.cumsum(marks[k], dtype=np.int32)[closed] - marks[k][closed] for k in (0, 1))
    return a[first] << _SHIFT | b[second], np.repeat(np.arange(len(n_a)), n_a)[first]


def _listed(encoded: DataFrame, lengths) -> DataFrame:
    """The id lists and group sizes as arrays, in place of the written numbers."""
    others = [c for c in encoded.columns if c not in ("a", "b")]
    names = [f"c{i}" for i in range(len(others))]
    schema = T.StructType([*[T.StructField(n, encoded.schema[c].dataType) for n, c in zip(names, others)], *LISTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for b in _slices(batch):
                (first, n_a), (second, n_b) = (_ids(b.column(k), _width(len(lengths.value[k]))) for k in (0, 1))
                sizes = []
                for x, y in zip(np.split(first, np.cumsum(n_a)[:-1]), np.split(second, np.cumsum(n_b)[:-1])):
                    ends = common_groups(lengths.value[0][x], lengths.value[1][y])
                    sizes.append([np.diff(np.array(e, np.int32), prepend=np.int32(0)) for e in ends])
                own, other = (_int_lists([s[k] for s in sizes]) for k in (0, 1))
                both = pa.StructArray.from_arrays([own.values, other.values], fields=[pa.field("n_a", pa.int32()), pa.field("n_b", pa.int32())])
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(v, pa.int32()))
                         for v, n in ((first, n_a), (second, n_b))]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[2:], *lists, pa.ListArray.from_arrays(own.offsets, both)], names=schema.names)

    out = encoded.select("a", "b", *[quoted(c).alias(n) for n, c in zip(names, others)]).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, others)], *LISTS.names)


def _lengths(files, readers: Sequence[type]):
    made = [reader(file) for reader, file in zip(readers, files.value)]
    return [np.array([len(x) for x in t.bytes], np.int64) for t in made]


_PAIR = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(b), _ROWS):
        yield b.slice(at, _ROWS)


def pair_counts(encoded: DataFrame, lengths) -> DataFrame:
    """``(pair, n)``: how many links of the corpus hold each pair of ids linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            keys, place = np.unique(keys, return_inverse=True)
            return keys, np.bincount(place, counts).astype(np.int64)

        def record(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=_PAIR.names)

        for batch in batches:
            for b in _slices(batch):
                held.append(np.unique(links(b.column(0), b.column(1), lengths.value)[0], return_counts=True))
                size += len(held[-1][0])
                if size > TABLE:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > TABLE // 2:
                        yield record(held[0])
                        held, size = [], 0
        if held:
            yield record(merged())

    return encoded.select("a", "b").mapInArrow(run, _PAIR).groupBy("pair").agg(F.sum("n").alias("n"))


_SCORE = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("n_best", T.LongType()),
    T.StructField("count_sum", T.LongType()), T.StructField("rare", T.ArrayType(_PAIR)),
])


def _scores(encoded: DataFrame, pairs: DataFrame, lengths, hot_pairs: int) -> DataFrame:
    """``n_links``, ``n_best`` and ``count_sum`` of each row."""
    context = encoded.sparkSession.sparkContext
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    histogram = {r["step"]: r["k"] for r in pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, taken = 1 << 20, 0
    for s in sorted(histogram, reverse=True):
        if taken + histogram[s] > hot_pairs:
            break
        least, taken = s, taken + histogram[s]
    hot = pairs.where(step >= least).toArrow()  # at most hot_pairs rows
    keys, counts = (hot.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(keys)
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    tops = materialise(pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("top")))  # one row an id
    best = tops.toArrow()
    highest = np.zeros(len(lengths.value[1]), np.int64)
    highest[best.column("b").to_numpy()] = best.column("top").to_numpy()
    sent = context.broadcast((keys[order], counts[order], highest))
    mask = (1 << _SHIFT) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        keys, counts, highest = sent.value
        for batch in batches:
            for b in _slices(batch):
                n = len(b)
                found, row = links(b.column(1), b.column(2), lengths.value)
                pair, place, many = np.unique(found, return_inverse=True, return_counts=True)
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                count = np.where(known, counts[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
                is_best = known & (count == highest[pair & mask])
                sums = np.zeros(n, np.int64)
                np.add.at(sums, row, count[place])
                rare = ~known[place]
                rare_pairs, rare_rows = found[rare], row[rare]
                order = np.lexsort((rare_pairs, rare_rows))
                rare_pairs, rare_rows = rare_pairs[order], rare_rows[order]
                new = np.ones(len(rare_pairs), bool)
                new[1:] = (rare_pairs[1:] != rare_pairs[:-1]) | (rare_rows[1:] != rare_rows[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(starts, append=len(rare_pairs))
                lists = pa.StructArray.from_arrays(
                    [pa.array(rare_pairs[starts], pa.int64()), pa.array(times, pa.int64())], names=_PAIR.names)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rare_rows[starts], minlength=n))])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.bincount(row, minlength=n)),
                     pa.array(np.bincount(row, is_best[place], n).astype(np.int64)), pa.array(sums),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists)], names=_SCORE.names)

    scored = encoded.select("row", "a", "b").mapInArrow(run, _SCORE)
    if taken == sum(histogram.values()):
        return scored.drop("rare")
    scored = materialise(scored)
    listed = scored.select("row", F.inline("rare")).withColumnRenamed("n", "times")
    # a pair outside the most frequent ones: no hot key
    counted = listed.join(pairs.where(step < least), "pair")
    counted = counted.withColumn("b", b_id).join(F.broadcast(tops), "b")
    more = counted.groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(F.lit(0))).alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    return scored.join(more, "row", "left").select(
        "row", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def align(
    docs: DataFrame, *, text: str = "text", first: str = BYTE_BPE, second: str = PIECE_BPE,
    carry: Sequence[str] | None = None, hot_pairs: int = HOT_PAIRS, lists: bool = True,
) -> DataFrame:
    """Texts with the digest of the groups, numbers of tokens, groups and links, ``n_best``
    (links whose pair's count is the highest of its second id) and ``count_sum`` (counts
    added over the links); with ``lists`` also both id lists and the size of each group.
    ``.json`` files are byte-level BPE, others piece models."""
    readers = [_reader(p) for p in (first, second)]
    files = _files(docs, (first, second))
    lengths = docs.sparkSession.sparkContext.broadcast(_lengths(files, readers))
    kept = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    encoded = materialise(_encoded(docs, text, files, readers, kept).withColumn("row", F.monotonically_increasing_id()))
    slim = encoded.select("row", "a", "b")
    pairs = materialise(pair_counts(slim, lengths))
    scores = _scores(slim, pairs, lengths, hot_pairs)
    if lists:
        encoded = _listed(encoded, lengths)
    out = encoded.join(scores, "row")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[c for c in OUTPUTS if lists or c in NUMBERS])
