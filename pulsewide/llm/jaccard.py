"""N-gram Jaccard join with token-combination prefixes, and its components.

A document's tokens are its distinct word shingles, as 64-bit hashes. All documents
order tokens alike, rare ones first, by a table of ``BUCKETS`` counts over the whole
corpus. Of two documents with a similarity of ``percent`` or more, a set of n tokens
misses at most tau = n - ceil(percent * n / 100) tokens of its own in the other.

* Rare tokens are indexed singly. Tokens of buckets far above the mean are frequent:
  they fall into classes by hash, and pairs of one class are indexed.
* The prefix is extended until its rare tokens, and its frequent ones but the first of
  each class, number tau + 1. If no single rare token and no pair were shared, at least
  those tau + 1 would be missing; so every linked pair shares an index entry.
* Sets of up to ``SMALL`` tokens index the plain prefix of tau + 1 single tokens. Larger
  ones are in size bands with as many classes as a band's smallest set can afford, so
  that pairs stay in proportion to the tokens. A set near a band's upper end is in the
  next band too, so that any two sets that can be linked meet in one.

Documents with equal sets are collapsed first. Index entries that one set alone has
drop out by a filter of once-seen and twice-seen entries, which a constant bounds. Of
an entry's sets each is compared with one center only, the set with the fewest odd
tokens: first by bitmaps of their tokens, which bound the overlap and rule most pairs out,
then by exact overlap of the whole sets. A center of very many sets is split into blocks. Sets that are linked with one center need no
comparison among themselves; the others meet where an entry holds sets of several
centers. Not compared are sets that cannot be linked by their sizes, by the place of the
entry in their order, or by how much their distances to the center differ. An entry that
one set alone has says nothing of the token: others index their prefixes only, and may
have it beyond these. So no group is paired out, and no link between components is missed.

Defined cases: null and empty texts, and texts without words, have no tokens and are
linked with nothing; a document of fewer words than a shingle is one token; rows of
equal id are one document, linked by any of its texts; a null id is linked with
nothing and has a null component; an empty table gives none. Only the id and the text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.llm.batches import fold, lean, quoted, texts_of
from pulsewide.llm.components import components
from pulsewide.operators.salting import join_distinct
from pulsewide.session import materialise

WORDS, PERCENT = 4, 85
BUCKETS_LOG2 = 20
#: A bucket is frequent above its mean plus six deviations plus this.
FREQUENT = 64
SMALL = 80
BAND = 4
#: Pairs of one id that meet in a block of their own.
BLOCK_PAIRS = 256
#: Bits of the filter for each index entry, and its bound.
ENTRY_BITS, MAX_BITS = 8, 1 << 29
#: Texts are hashed together up to about so many bytes, which stay in the processor's cache.
_CHUNK_BYTES = 1 << 17

#: White space becomes a space, A-Z become a-z.
_PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What keeps the first k bytes of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_random = np.random.Generator(np.random.PCG64(20240501))
_PLACES = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xD6E8FEB86659FD93)
#: The bit that entries of single tokens have and those of pairs have not.
_SINGLE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SALTS = _mix(np.arange(1, 65, dtype=np.uint64))


def _word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's words begin (one more).

    Words are read eight bytes at a time, all words together.
    """
    data = b" " + b" ".join(texts).translate(_PLAIN) + b" " * 9
    inside = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    lengths = ends - starts
    eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    hashes = _mix((eight[starts] & _KEEP[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _SHORT)
    rest, at = np.flatnonzero(lengths > 8), 8
    while len(rest):
        part = eight[starts[rest] + at] & _KEEP[np.minimum(lengths[rest] - at, 8)]
        hashes[rest] = _mix(hashes[rest] * _BASE ^ part)
        at += 8
        rest = rest[lengths[rest] > at]
    limits = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return hashes, np.searchsorted(starts, limits)


def token_sets(texts: Iterable[bytes | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        chunk.append(t or b"")
        size += len(chunk[-1])
        if size >= _CHUNK_BYTES:
            yield from _chunk_sets(chunk, words)
            chunk, size = [], 0
    if chunk:
        yield from _chunk_sets(chunk, words)


def _chunk_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, begins = _word_hashes(texts)
    shingles = np.zeros(0, np.uint64)
    if len(hashes) >= words:
        total = np.zeros(len(hashes) - words + 1, np.uint64)
        for j in range(words):
            total = total + hashes[j : len(hashes) - words + 1 + j] * _PLACES[j]
        shingles = _mix(total)
    for first, end in zip(begins[:-1], begins[1:]):
        n = int(end - first)
        if n >= words:
            tokens = np.sort(shingles[first : end - words + 1])
            fresh = np.empty(len(tokens), bool)
            fresh[0] = True
            np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
            yield tokens[fresh]
        elif n:
            one = (hashes[first:end] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True)
            yield _mix(one ^ _mix(np.array([n], np.uint64)))
        else:
            yield np.zeros(0, np.uint64)


def _least(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked set has at least."""
    return -(-percent * n // 100)


def _bands(n: int, percent: int) -> list[tuple[int, int]]:
    """The bands of a set as (number, classes); band 0 has none."""
    found = [(0, 0)] if n <= SMALL else []
    band, low = 1, SMALL
    while 100 * n > percent * low:
        if n <= low * BAND:
            found.append((band, max(1, percent * percent * low // 10_000 - 2)))
        band, low = band + 1, low * BAND
    return found


def _seen(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(tokens >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)]


def _odd(seen: np.ndarray) -> int:
    """Tokens seen less than half as often as the set's median token."""
    return int((2 * seen < np.median(seen)).sum())


def _bitmap(tokens: np.ndarray) -> bytes:
    """Two to four bits for each token, at places given by the tokens' low bits."""
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _most_common(n: int, m: int, one: bytes, other: bytes) -> int:
    """A bound of two sets' overlap: each mark that only one has is a token that only it has."""
    a, b = (np.frombuffer(x, "<u8") for x in (one, other))
    if len(a) > len(b):
        a, n, b, m = b, m, a, n
    only_a = int(np.bitwise_count(a & ~np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)).sum())
    wide = np.tile(a, len(b) // len(a))  # every place whose low bits have a mark
    only_b = int(np.bitwise_count(b & ~wide).sum())
    return min(n - only_a, m - only_b)


def _entries(tokens: np.ndarray, seen: np.ndarray, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set, hashes of rare tokens and of pairs of frequent ones, and
    for each how many tokens the set has from there on in the common order."""
    n = len(tokens)
    order = np.argsort(seen, kind="stable")  # the tokens come sorted, so ties are in their order
    tokens, frequent = tokens[order], seen[order] > limit
    rare = n - int(frequent.sum())  # and these come first
    needed = n - _least(n, percent) + 1
    out, rest = [], []

    def singles(chosen: np.ndarray, salt: np.uint64) -> None:
        out.append(_mix(chosen ^ salt) | _SINGLE)
        rest.append(np.arange(n, n - len(chosen), -1))

    for band, classes in _bands(n, percent):
        salt = _SALTS[band]
        if not band or needed <= rare:
            singles(tokens[:needed], salt)
            continue
        group = (tokens % np.uint64(classes)).astype(np.int64)
        counted = np.ones(n, np.int64)
        counted[rare + np.unique(group[rare:], return_index=True)[1]] = 0
        size = int(np.searchsorted(np.cumsum(counted), needed)) + 1
        singles(tokens[:rare], salt)
        paired, kind = tokens[rare:size], group[rare:size]
        inner = np.lexsort((paired, kind))
        paired, kind = paired[inner], kind[inner]
        step = 1
        while step < len(paired) and (same := kind[step:] == kind[:-step]).any():
            out.append(_mix(_mix(paired[:-step][same] ^ salt) + paired[step:][same] * _BASE) & ~_SINGLE)
            rest.append(np.full(len(out[-1]), n - rare))
            step += 1
    return np.concatenate(out), np.concatenate(rest)


def _bucket_counts(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many tokens of all documents fall into each bucket."""

    def start(arrays):
        def update(columns):
            for tokens in token_sets(texts_of(columns[0]), words):
                np.add.at(arrays[0], (tokens >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), 1)

        return update

    def merge(a, b):
        a[0] += b[0]

    return fold(docs, [text], ["int64"], 1 << BUCKETS_LOG2, start, merge, keep=[0])[0]


def _features(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``id``, number of tokens, of odd ones, digest of the set and its index entries."""
    counts = _bucket_counts(docs, text, words)
    mean = float(counts.sum()) / len(counts)
    limit = int(mean + 6 * mean**0.5) + FREQUENT
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("odd", T.LongType()),
        T.StructField("same", T.BinaryType()), T.StructField("entries", T.ArrayType(T.LongType())),
        T.StructField("rests", T.ArrayType(T.IntegerType())), T.StructField("bits", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            sizes, odd, same, entries, rests, bits = [], [], [], [], [], []
            for tokens in token_sets(texts_of(b.column(1)), words):
                seen = _seen(tokens, shared.value)
                sizes.append(len(tokens))
                odd.append(_odd(seen) if len(tokens) else 0)
                same.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                own, rest = _entries(tokens, seen, limit, percent) if len(tokens) else (tokens, tokens)
                entries.append(own.view(np.int64))
                rests.append(rest.astype(np.int32))
                bits.append(_bitmap(tokens))
            ends = pa.array(np.cumsum([0, *map(len, entries)], dtype=np.int32), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x or [np.zeros(0)]), t))
                     for x, t in ((entries, pa.int64()), (rests, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(odd, pa.int64()), pa.array(same, pa.binary()), *lists,
                 pa.array(bits, pa.binary())],
                names=schema.names,
            )

    return docs.select(quoted(key).alias("id"), quoted(text).cast("string").alias("t")).mapInArrow(run, schema)


def _places(entries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = entries.view(np.uint64)
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(34)) & mask).astype(np.int64)


def _set(array: np.ndarray, places: tuple[np.ndarray, ...]) -> None:
    for p in places:
        np.bitwise_or.at(array, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))


def _is_set(array: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
    found = [(array[p >> 3] >> (p & 7).astype(np.uint8)) & 1 for p in places]
    return (found[0] & found[1]).astype(bool)


def _shared_entries(sets: DataFrame, percent: int) -> DataFrame:
    """``(entry, id, n, odd, rest)`` without most of the entries that one set alone has.

    At the first entry that two sets share, no token before it is common, so ``rest``, the
    tokens from there on, bounds their overlap. Entries too late for a link drop out.
    """
    total = sets.agg(F.sum(F.size("entries").cast("bigint"))).first()[0] or 0
    bits = 1 << 20
    while bits < MAX_BITS and bits < ENTRY_BITS * total:
        bits *= 2

    def start(arrays):
        once, twice = arrays

        def update(columns):
            entries, n = np.unique(columns[0].flatten().to_numpy(zero_copy_only=False), return_counts=True)
            places = _places(entries, bits)
            again = (n > 1) | _is_set(once, places)
            _set(twice, tuple(p[again] for p in places))
            _set(once, places)

        return update

    def merge(a, b):
        a[1] |= b[1] | a[0] & b[0]
        a[0] |= b[0]

    twice = sets.sparkSession.sparkContext.broadcast(
        fold(sets, ["entries"], ["uint8", "uint8"], bits // 8, start, merge, keep=[1])[0]
    )
    schema = T.StructType([
        T.StructField("entry", T.LongType()), T.StructField("id", sets.schema["id"].dataType),
        T.StructField("n", T.LongType()), T.StructField("odd", T.LongType()), T.StructField("rest", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            again = _is_set(twice.value, _places(flat, bits))
            n = b.column(1).to_numpy(zero_copy_only=False)
            rest = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            kept = np.flatnonzero(again & (100 * rest >= percent * n[owner]))
            rows = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[kept], pa.int64()), *[b.column(k).take(rows) for k in (0, 1, 3)], pa.array(rest[kept], pa.int64())],
                names=schema.names,
            )

    return sets.select("id", "n", "entries", "odd", "rests").mapInArrow(run, schema)


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with a block of their second id, and the number of blocks of each such id: one
    with very many partners is split, and its text goes once to each block."""
    blocks = materialise(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PAIRS).cast("int").alias("blocks")))
    dealt = join_distinct(pairs, blocks, "v", "inner").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")))
    return materialise(dealt.select("u", "v", F.col("block").cast("int").alias("block"))), blocks


def _to_blocks(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """A table with ids ``v``, once for each block of the id."""
    return table.join(blocks, "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _bounded(dealt: DataFrame, blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the least ``distance`` that their sizes and bitmaps leave possible; zero
    for an id of several texts."""
    one = sets.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("bits").alias("bits")).where("k = 1").drop("k")
    first = one.withColumnsRenamed({"id": "u", "bits": "bu"})
    second = _to_blocks(one.withColumnsRenamed({"id": "v", "n": "m", "bits": "bv"}), blocks)
    held = dealt.join(first, "u", "left").join(second, ["v", "block"], "left").select("u", "v", "block", "n", "m", "bu", "bv")
    schema = T.StructType([*dealt.select("u", "v", "block").schema.fields, T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            least = []
            for n, m, one, other in zip(*[b.column(k).to_pylist() for k in range(3, 7)]):
                most = None if one is None or other is None else _most_common(n, m, one, other)
                least.append(0.0 if most is None else 1 - most / (n + m - most))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(least, pa.float64())], names=schema.names)

    return held.mapInArrow(run, schema)


def _compared(
    pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int
) -> DataFrame:
    """Pairs with bounds ``low`` and ``high`` of the Jaccard distance of their whole sets and
    whether they are ``linked``. Pairs whose bitmaps rule a link out are done; of the others
    the texts are compared, and both bounds are the distance. Texts come by two joins on the
    id; only texts of documents in some pair, by a filter of their ids, are moved."""
    dealt, blocks = _dealt(pairs)
    bounded = materialise(_bounded(dealt, blocks, sets))
    possible = F.col("distance") <= 1 - percent / 100 + 1e-9
    ruled_out = bounded.where(~possible).select(
        "u", "v", F.col("distance").alias("low"), F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
    chosen = bounded.where(possible)
    kind = docs.schema[key].dataType
    n_bits, total = 1 << 20, chosen.count()
    while n_bits < MAX_BITS and n_bits < ENTRY_BITS * total:
        n_bits *= 2

    def start(arrays):
        def update(columns):
            for array, c in zip(arrays, columns):
                _set(array, (_places(c.to_numpy(zero_copy_only=False), n_bits)[0],))

        return update

    def merge(a, b):
        for x, y in zip(a, b):
            x |= y

    hashed = chosen.select(F.xxhash64("u").alias("hu"), F.xxhash64("v").alias("hv"))
    found = fold(hashed, ["hu", "hv"], ["uint8", "uint8"], n_bits // 8, start, merge, keep=[0, 1])
    wanted = {side: docs.sparkSession.sparkContext.broadcast(f) for side, f in zip(("u", "v"), found)}
    schema = T.StructType([T.StructField("id", kind), T.StructField("t", T.StringType())])

    def texts(side: str) -> DataFrame:
        sought = wanted[side]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            for b in batches:
                p = _places(b.column(0).to_numpy(zero_copy_only=False), n_bits)[0]
                rows = pa.array(np.flatnonzero((sought.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1))
                yield pa.RecordBatch.from_arrays([b.column(1).take(rows), b.column(2).take(rows)], names=["id", "t"])

        source = docs.where(quoted(key).isNotNull()).select(
            F.xxhash64(quoted(key)).alias("h"), quoted(key).alias("id"), quoted(text).cast("string").alias("t"))
        return source.mapInArrow(run, schema).withColumnsRenamed({"id": side, "t": f"t{side}"})

    both = (
        chosen.join(texts("u"), "u").join(_to_blocks(texts("v"), blocks), ["v", "block"])
        .select("u", "v", "tu", "tv")
    )
    out = T.StructType([
        T.StructField("u", kind), T.StructField("v", kind), T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()), T.StructField("linked", T.BooleanType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        last_text, last = b"", np.zeros(0, np.uint64)  # rows come by v, whose set serves many u
        for b in batches:
            distance, linked = [], []
            for mine, second in zip(token_sets(texts_of(b.column(2)), words), texts_of(b.column(3))):
                if (second or b"") != last_text:
                    last_text, last = second or b"", next(token_sets([second], words))
                common = len(np.intersect1d(mine, last, assume_unique=True))
                union = len(mine) + len(last) - common
                distance.append(1 - common / max(union, 1))
                linked.append(bool(common) and 100 * common >= percent * union)
            distance = pa.array(distance, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), distance, distance, pa.array(linked, pa.bool_())], names=out.names)

    return both.mapInArrow(compare, out).union(ruled_out)


def _links(shared: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Links ``(u, v)``, enough to make all components, from the sets of each entry.

    First every set meets its entry's center. ``part`` is then the smallest center that a
    set is linked with; sets of one part need not meet. ``low`` and ``high`` bound the
    distance to the entry's center. Jaccard distance is a metric, so two sets whose
    distances differ by more than a link allows are not linked.
    """
    far = 1 - percent / 100 + 1e-9
    most = F.least("rest", "rest_v")  # of the overlap, if this is their first common entry
    fits = 100 * most >= percent * (F.col("n") + F.col("m") - most)
    groups = shared.groupBy("entry").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("odd", "id")).alias("best")).where("k > 1")
    rows = materialise(shared.join(groups, "entry").select("entry", "id", "n", "rest", F.col("best.id").alias("center")))

    def other(chosen: DataFrame, *more: str) -> DataFrame:
        return chosen.select("entry", F.col("id").alias("v"), F.col("n").alias("m"), F.col("rest").alias("rest_v"),
                             *[F.col(c).alias(f"{c}_v") for c in more])

    members = rows.where(F.col("id") != F.col("center"))
    stars = members.join(other(rows.where(F.col("id") == F.col("center"))), "entry").where(fits)
    stars = materialise(stars.select(F.col("id").alias("u"), "v").distinct())
    met = materialise(_compared(stars, sets, docs, key, text, words, percent))

    parts = met.where("linked").groupBy(F.col("u").alias("id")).agg(F.min("v").alias("part"))
    distances = met.groupBy(F.col("u").alias("id"), F.col("v").alias("center")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    members = members.join(parts, "id", "left").join(distances, ["id", "center"], "left").select(
        "entry", "id", "n", "rest", F.coalesce("part", "id").alias("part"),
        F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))
    several = members.groupBy("entry").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first != last")
    members = materialise(members.join(several.select("entry"), "entry"))
    pairs = members.join(other(members, "part", "low", "high"), "entry").where(
        (F.col("id") > F.col("v")) & (F.col("part") != F.col("part_v")) & fits
        & (F.col("low") - F.col("high_v") <= far) & (F.col("low_v") - F.col("high") <= far))
    pairs = materialise(pairs.select(F.col("id").alias("u"), "v").distinct())
    rest = _compared(pairs, sets, docs, key, text, words, percent)
    return materialise(met.union(rest).where("linked").select("u", "v"))


def near_duplicate_groups(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row for each row of ``docs``: its key, ``n_shingles`` and ``component_id``,
    the smallest key that links lead to. ``percent`` is from 50 to 100."""
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be from 50 to 100; got {percent!r}")
    features = materialise(_features(docs, key, text, words, percent))
    linked = features.where("n > 0 and id is not null")
    sets = materialise(linked.groupBy("same").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("odd").alias("odd"),
        F.first("entries").alias("entries"), F.first("rests").alias("rests"), F.first("bits").alias("bits")))
    shared = materialise(_shared_entries(sets, percent))
    edges = _links(shared, sets, docs, key, text, words, percent)
    named = sets.select("same", F.col("id").alias("first"))
    # rows of equal id are one document: all its sets are linked
    several = linked.groupBy("id").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a != b").select("id")
    several = materialise(several)
    if not several.isEmpty():
        known = linked.join(several, "id").join(named, "same").select(F.col("id").alias("u"), F.col("first").alias("v"))
        edges = edges.union(known)
    labels = components(edges)
    named = named.join(labels, F.col("first") == F.col("node"), "left").select(
        "same", F.coalesce("component", "first").alias("first"))
    out = features.join(named, (features["same"] == named["same"]) & (features["n"] > 0) & features["id"].isNotNull(), "left")
    return out.select(
        features["id"].alias(key), features["n"].alias("n_shingles"),
        F.coalesce(named["first"], features["id"]).alias("component_id"),
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that with the smallest key. Of rows with equal key
    the first by text stays; rows without a key stay."""
    groups = near_duplicate_groups(docs, key=key, text=text, words=words, percent=percent)
    least = groups.groupBy(quoted(key).alias(key)).agg(F.min("component_id").alias("component_id"))
    first = least.where(quoted(key) == F.col("component_id")).select(quoted(key))
    kept = docs.where(quoted(key).isNotNull()).join(first, key, "left_semi")
    others = [quoted(c) for c in docs.columns if c not in (key, text)]
    number = F.row_number().over(Window.partitionBy(quoted(key)).orderBy(quoted(text), *others))
    kept = kept.withColumn("row_of_key", number).where("row_of_key = 1").select(*[quoted(c) for c in docs.columns])
    return kept.union(docs.where(quoted(key).isNull()))
