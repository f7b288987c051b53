"""Line deduplication with two Bloom filters and an exact second look.

1. Every task puts the hashes of its documents' line keys into a filter of keys seen
   once, and those that are there already into a filter of keys seen twice. Merging
   two tasks, a bit set in both once-filters goes to the twice-filter, so a key of two
   documents is always in the latter. One document counts a key once.
2. Only keys in the twice-filter are suspects. Their 128-bit digests are counted, with
   a partial count in each task, and those of fewer than ``min_docs`` documents drop out.
3. The digests that remain go to the tasks in blocks of ``block_keys``; each block is
   a narrow pass over the documents, the last of which writes the kept text.

The filters have 16 bits for each line, between 2^20 and ``max_bits``: a bound on what
is broadcast. When lines outgrow it there are more suspects to count, never another
result. No text is shuffled; a line in a third of all documents is one row per task.

Defined cases: a null or empty text is one empty line, which stays; lines whose key has
fewer than ``min_chars`` code points stay; repeated rows count as documents of their
own; an empty table gives an empty table. Columns that have an output's name are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.session import materialise
from pulsewide.llm.batches import ASCII_SPACE, add_columns, fold, lean, quoted, texts_of

MIN_DOCS = 10
MIN_CHARS = 1
MAX_BITS = 1 << 29
BITS_PER_LINE = 16
BLOCK_KEYS = 1_000_000


def _keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of each line; None for a line that always stays."""
    keys = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(ASCII_SPACE).lower()
        n = len(key)
        if n >= 4 * min_chars or n >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
            keys.append(key)
        else:
            keys.append(None)
    return keys


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _has(filter_: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    found = None
    for p in places:
        bit = (filter_[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        found = bit if found is None else found & bit
    return found.astype(bool)


def _put(filter_: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(filter_, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def _hashes(texts: Iterable[bytes | None], min_chars: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    out: list[int] = []
    for t in texts:
        out.extend(map(digest, {k for k in _keys(t, min_chars) if k is not None}))
    return np.array(out, np.uint64)


def twice_seen(docs: DataFrame, text: str, min_chars: int, bits: int) -> np.ndarray:
    """The filter of keys that two or more documents have."""

    def start(arrays):
        once, twice = arrays

        def update(columns):
            hashes, counts = np.unique(_hashes(texts_of(columns[0]), min_chars), return_counts=True)
            places = _places(hashes, bits)
            again = (counts > 1) | _has(once, places)
            _put(twice, tuple(p[again] for p in places))
            _put(once, places)

        return update

    def merge(a, b):
        a[1] |= b[1] | a[0] & b[0]
        a[0] |= b[0]

    return fold(docs, [text], ["uint8", "uint8"], bits // 8, start, merge, keep=[1])[0]


def _suspects(docs: DataFrame, text: str, min_chars: int, bits: int, twice, order: Sequence[str]) -> DataFrame:
    """A row for each document and suspected key: its digest and first line there."""
    schema = T.StructType(
        [T.StructField("digest", T.BinaryType()), T.StructField("line", T.IntegerType())]
        + [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(order)]
    )

    def run(batches):
        lean()
        for b in batches:
            firsts, rows = [], []
            for row, t in enumerate(texts_of(b.column(0))):
                seen: dict[bytes, int] = {}
                for line, k in enumerate(_keys(t, min_chars)):
                    if k is not None:
                        seen.setdefault(k, line)
                firsts.extend(seen.items())
                rows.extend([row] * len(seen))
            if not firsts:
                continue
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k, _ in firsts], np.uint64)
            at = np.flatnonzero(_has(twice.value, _places(hashes, bits)))
            picked = pa.array([rows[i] for i in at], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(firsts[i][0]) for i in at], pa.binary()),
                 pa.array([firsts[i][1] for i in at], pa.int32()),
                 *[c.take(picked) for c in b.columns[1:]]],
                names=schema.names,
            )

    return docs.select(quoted(text).alias("t"), *[quoted(c).alias(f"k{i}") for i, c in enumerate(order)]).mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame,
    *,
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep_first: str | None = None,
    max_bits: int = MAX_BITS,
    block_keys: int = BLOCK_KEYS,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line goes if its key is found in at least ``min_docs`` documents. With
    ``keep_first``, a column that identifies documents, each such key's first line in
    the document with the smallest value stays.
    """
    spark = docs.sparkSession
    t = quoted(text)
    lines = docs.agg(F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = 1 << 20
    while bits < max_bits and bits < BITS_PER_LINE * lines:
        bits *= 2
    twice = spark.sparkContext.broadcast(twice_seen(docs, text, min_chars, bits))
    order = [keep_first] if keep_first else []
    suspects = _suspects(docs, text, min_chars, bits, twice, order)
    firsts = [F.min(F.struct("k0", "line")).alias("first")] if keep_first else []
    common = (
        suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), *firsts).where(F.col("n") >= min_docs)
        .select("digest", *(["first"] if keep_first else []))
    )
    common = materialise(common)
    n_blocks = max(1, -(-common.count() // block_keys))
    for block in range(n_blocks):
        here = common.where(F.pmod(F.xxhash64("digest"), F.lit(n_blocks)) == block) if n_blocks > 1 else common
        keys = {
            bytes(r["digest"]): (r["first"]["k0"], r["first"]["line"]) if keep_first else None for r in here.collect()
        }
        docs = _drop(docs, text, min_chars, spark.sparkContext.broadcast(keys), order,
                     first=block == 0, last=block == n_blocks - 1, carry=carry)
    return docs


def _drop(docs, text, min_chars, shared, order, first: bool, last: bool, carry) -> DataFrame:
    marked = T.StructField("dropped_lines", T.ArrayType(T.IntegerType()))
    final = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    outputs = T.StructType(final if last else [marked])

    def start():
        common = shared.value

        def work(columns):
            marks = [[]] * len(columns[0]) if first else columns[1].to_pylist()
            owners = columns[-1].to_pylist() if order else None
            gone_all, n_lines, kept = [], [], []
            for i, t in enumerate(texts_of(columns[0])):
                gone = set(marks[i])
                for line, k in enumerate(_keys(t, min_chars)):
                    if k is not None:
                        d = xxhash.xxh3_128_digest(k)
                        if d in common and not (order and common[d] == (owners[i], line)):
                            gone.add(line)
                gone_all.append(gone)
                if last:
                    whole = (t or b"").split(b"\n")
                    n_lines.append(len(whole))
                    kept.append(b"\n".join([x for j, x in enumerate(whole) if j not in gone]) if gone else t or b"")
            if not last:
                return [pa.array([sorted(g) for g in gone_all], pa.list_(pa.int32()))]
            return [pa.array(n_lines, pa.int64()), pa.array([len(g) for g in gone_all], pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string())]

        return work

    inputs = [text, *([] if first else [F.col("dropped_lines")]), *order]
    keep = [c for c in (docs.columns if carry is None else carry) if c != "dropped_lines"]
    if not last:
        keep = list(dict.fromkeys([*keep, text, *order]))
    return add_columns(docs, inputs, outputs, start, keep)
