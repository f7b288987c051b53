"""Embedding near-duplicates by spherical-cap filters from random product codes.

A filter is a direction; a vector belongs to it if their inner product reaches ``alpha``.
Directions are structured: after a random rotation each of ``CODES`` codes deals the
coordinates into blocks with random code words of their own, and a direction is one word of
every block. A vector's filters are decoded block by block, best words first; a partial
choice is given up when even the best words of the blocks to come cannot lift it to
``alpha``. Vectors meet in the filters they share, and each pair that meets is verified by
its cosine in double precision. Filters of one code hang together, those of different codes
do not: hence several.

What the parameters follow (:class:`Code`): a filter holds about ``BUCKET`` vectors on
average (or as many as are within the threshold of a vector, where these are more), so
``alpha`` rises with the number of vectors; the number of filters of a vector is such that
a pair just at the threshold shares ``SHARED`` of them on average. It then misses all of
them in well under one case of a hundred, and closer pairs hardly ever. Filters do not
depend on the data, so a vector's list has the same expected length anywhere.

* Vectors of equal direction are one class; only classes are decoded and compared.
* A pair is counted in the smallest filter that both have. No pair leaves its task:
  it emits one sum for each class and a spanning forest of the links found.
* A filter with more than ``SPLIT`` vectors above the average is cut into blocks, and
  every two blocks meet in a task of their own. How many blocks follows from 2^20 counters
  (8 MB, whatever the data), which can only say too many.
* The shuffle moves a class once for each of its filters, with its vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, nor do vectors of different length; a row of null id links with nothing
and has a null component; each row is a vector of its own, also one with an id seen before,
which is then linked only if its vector is; an empty table gives none. Only the id and the
embedding are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.llm.batches import fold, lean, quoted
from pulsewide.llm.components import components
from pulsewide.operators.salting import join_distinct
from pulsewide.session import materialise

THRESHOLD = 0.9
BUCKET = 64
SHARED = 12.0
SPLIT = 1024
COUNTERS_LOG2 = 20
#: A filter takes no larger share of all directions than this, however few vectors there are,
#: unless more are within the threshold.
MAX_SHARE = 0.02
CODES = 32
MAX_WORDS = 512
_SEED = 20240713
#: Vectors that are decoded together.
_SLICE = 128
_DIM_SHIFT = 40
#: Rows that are passed on together.
_OUT_ROWS = 1 << 14


def _cap_shares(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of all directions that is within each of a given one."""
    angles = (np.arange(200_000) + 0.5) * (math.pi / 200_000)
    log_density = (dim - 2) * np.log(np.sin(angles))
    mass = np.cumsum(np.exp(log_density - log_density.max()))
    return angles, mass / mass[-1]


def cap_share(angle: np.ndarray | float, dim: int) -> np.ndarray:
    if dim == 1:  # two directions
        return np.where(np.asarray(angle) < math.pi, 0.5, 1.0)
    return np.interp(angle, *_cap_shares(dim))


def met_share(angle: float, cosine: float, dim: int) -> float:
    """The share of a vector's filters (within ``angle`` of it) that one at this cosine has too."""
    angles = (np.arange(2000) + 0.5) * (angle / 2000)
    log_density = (dim - 2) * np.log(np.sin(angles))
    weight = np.exp(log_density - log_density.max())
    need = (math.cos(angle) - cosine * np.cos(angles)) / (math.sqrt(1 - cosine * cosine) * np.sin(angles))
    met = cap_share(np.arccos(np.clip(need, -1, 1)), dim - 1) * (need <= 1)
    return float((weight * met).sum() / weight.sum())


class Code:
    """The filters for vectors of one length: a rotation, and by code an order of the
    coordinates and the words of each block."""

    def __init__(self, dim: int, n: int, threshold: float, shared: float, bucket: int) -> None:
        self.dim = max(2, dim)
        neighbours = float(cap_share(math.acos(threshold), self.dim))
        share = max(min(MAX_SHARE, bucket / max(n, 1)), neighbours)
        angle = float(np.interp(share, *_cap_shares(self.dim)[::-1]))
        self.alpha = math.cos(angle)
        per_code = shared / met_share(angle, threshold, self.dim) / share / CODES
        least = 2 if self.dim >= 8 else 1  # few coordinates are not cut
        blocks = min(self.dim, max(least, math.ceil(math.log(max(per_code, 2)) / math.log(MAX_WORDS))))
        self.n_words = max(2, math.ceil(per_code ** (1 / blocks)))
        self.size = self.n_words**blocks
        random = np.random.Generator(np.random.PCG64([_SEED, self.dim]))
        self.rotation = np.linalg.qr(random.standard_normal((self.dim, self.dim)))[0]
        self.codes = []
        for _ in range(CODES):
            code = []
            for block in np.array_split(random.permutation(self.dim), blocks):
                words = random.standard_normal((self.n_words, len(block)))
                code.append((block, words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(blocks)))
            self.codes.append(code)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, filter) whose inner product reaches ``alpha``, by row and filter."""
        wide = np.zeros((len(units), self.dim))
        wide[:, : units.shape[1]] = units
        turned = wide @ self.rotation
        found = []
        for number, code in enumerate(self.codes):
            rows, filters = self._decode_one(turned, code)
            found.append((rows, filters + number * self.size))
        rows, filters = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]

    def _decode_one(self, turned: np.ndarray, code: list) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(turned), self.n_words
        products = [turned[:, block] @ words.T for block, words in code]
        to_come, least = np.zeros(n), []  # what a partial sum must reach after each block
        for p in reversed(products):
            least.append(self.alpha - to_come)
            to_come = to_come + p.max(axis=1)
        rows, sums, filters = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
        for p, bound in zip(products, reversed(least)):
            best = np.argsort(-p, axis=1, kind="stable")
            falling = np.take_along_axis(p, best, axis=1)
            # one search for all rows: each row's values are moved to a range of its own
            lifted = (4.0 * np.arange(n)[:, None] - falling).ravel()
            need = 4.0 * rows - (bound[rows] - sums)
            many = np.clip(np.searchsorted(lifted, need, "right") - rows * k, 0, k)
            at = np.repeat(np.arange(len(rows)), many)
            rank = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            rows = rows[at]
            sums, filters = sums[at] + falling[rows, rank], filters[at] * k + best[rows, rank]
        return rows, filters


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The vector of each row, or none where it cannot link."""
    values = column.flatten()
    numbers = values.to_numpy(zero_copy_only=False)  # null components become NaN
    at = 0
    for valid, n in zip(column.is_valid().to_pylist(), column.value_lengths().to_pylist()):
        if not valid:
            yield None
            continue
        v = numbers[at : at + n]
        at += n
        yield v if n and np.isfinite(v).all() and v.any() else None


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, whatever their size."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _hashed(filters: np.ndarray) -> np.ndarray:
    mixed = filters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)


def _read(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """``id``, number of components, digest of the direction and bytes of the vector."""
    element = df.schema[embedding].dataType.elementType
    narrow = isinstance(element, T.FloatType)
    number = np.float32 if narrow else np.float64
    schema = T.StructType([
        T.StructField("id", df.schema[key].dataType), T.StructField("dim", T.IntegerType()),
        T.StructField("same", T.BinaryType()), T.StructField("vector", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            dims, same, vectors = [], [], []
            for known, v in zip(b.column(0).is_valid().to_pylist(), _vectors(b.column(1))):
                if v is None or not known:
                    dims.append(None), same.append(None), vectors.append(None)
                    continue
                direction = unit(v[None, :])[0] + 0.0  # no negative zeros
                dims.append(len(v))
                same.append(xxhash.xxh3_128_digest(direction.tobytes()))
                vectors.append(v.astype(number).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(dims, pa.int32()), pa.array(same, pa.binary()), pa.array(vectors, pa.binary())],
                names=schema.names)

    kind = "array<float>" if narrow else "array<double>"
    return df.select(quoted(key).alias("id"), quoted(embedding).cast(kind).alias("v")).mapInArrow(run, schema)


class _Codes(dict):
    """The code of each vector length, made where it is first needed."""

    def __init__(self, n: int, threshold: float, shared: float, bucket: int) -> None:
        self._rest = (n, threshold, shared, bucket)

    def __missing__(self, dim: int) -> Code:
        self[dim] = Code(dim, *self._rest)
        return self[dim]


def _decoded(classes: DataFrame, number: type, settings: tuple) -> DataFrame:
    """Classes with their sorted filters."""
    schema = T.StructType([*classes.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))])
    fields = classes.columns
    at_dim, at_vector = fields.index("dim"), fields.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        codes = _Codes(*settings)
        for batch in batches:
            for first in range(0, len(batch), _SLICE):
                b = batch.slice(first, _SLICE)
                dims, raw = b.column(at_dim).to_numpy(), b.column(at_vector).to_pylist()
                lists = [np.zeros(0, np.int64)] * len(dims)
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    units = unit(np.frombuffer(b"".join(raw[i] for i in own), number).reshape(len(own), dim))
                    rows, filters = codes[dim].decode(units)
                    filters = filters + (int(dim) << _DIM_SHIFT)
                    for i, part in zip(own, np.split(filters, np.searchsorted(rows, np.arange(1, len(own))))):
                        lists[i] = part
                ends = pa.array(np.cumsum([0, *map(len, lists)], dtype=np.int32), pa.int32())
                made = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists), pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)

    return classes.mapInArrow(run, schema)


def _block_counts(decoded: DataFrame, split: int) -> np.ndarray:
    """How many blocks the filters of each counter are cut into."""

    def start(arrays):
        def update(columns):
            filters = columns[0].flatten().to_numpy(zero_copy_only=False)
            np.add.at(arrays[0], _hashed(filters), 1)

        return update

    def merge(a, b):
        a[0] += b[0]

    found = fold(decoded, ["filters"], ["int64"], 1 << COUNTERS_LOG2, start, merge, keep=[0])[0]
    mean = found.sum() / len(found)
    return np.maximum(1, np.ceil((found - mean - 6 * math.sqrt(mean)) / split)).astype(np.int32)


_MEMBER = T.StructType([
    T.StructField("filter", T.LongType()), T.StructField("one", T.IntegerType()), T.StructField("two", T.IntegerType()),
    T.StructField("side", T.BooleanType()), T.StructField("same", T.BinaryType()), T.StructField("rows", T.LongType()),
    T.StructField("vector", T.BinaryType()), T.StructField("filters", T.ArrayType(T.LongType())),
])


def _members(decoded: DataFrame, blocks: np.ndarray) -> DataFrame:
    """One row for each class and filter; in a filter of b blocks one for each of the b
    pairs of blocks that the class has a part in, ``side`` saying which of the two is its own."""
    shared = decoded.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for first in range(0, len(batch), _SLICE):
                b = batch.slice(first, _SLICE)
                lists = b.column(3)
                filters = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                n = shared.value[_hashed(filters)]
                deal = np.array([xxhash.xxh3_64_intdigest(s) >> 33 for s in b.column(0).to_pylist()], np.int64)
                block = (deal[owner] % n).astype(np.int32)
                # a filter of very many blocks is passed on in parts
                for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // _OUT_ROWS)) + 1):
                    times = n[part]
                    own = np.repeat(block[part], times)
                    other = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                    rows = pa.array(np.repeat(owner[part], times))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(filters[part], times)), pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)),
                         pa.array(own > other), *[b.column(k).take(rows) for k in range(4)]], names=_MEMBER.names)

    return decoded.select("same", "rows", "vector", "filters").mapInArrow(run, _MEMBER)


def _seen_before(lists: list[np.ndarray], chosen: int) -> np.ndarray:
    """Which pairs of members share a filter smaller than ``chosen``."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists)
    owner, flat = owner[flat < chosen], flat[flat < chosen]
    _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    several = n > 1
    if not several.any():
        return np.zeros((len(lists), len(lists)), bool)
    marks = np.zeros((len(lists), int(several.sum())), np.float32)
    column = np.cumsum(several) - 1
    kept = several[place]
    marks[owner[kept], column[place[kept]]] = 1
    return marks @ marks.T > 0


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each one's links lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND = T.StructType([
    T.StructField("same", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType()),
])


def _verified(members: DataFrame, number: type, threshold: float) -> DataFrame:
    """Of each two blocks: per class its links first met here, and its root among them."""

    def compare(key: tuple, group: list[tuple]) -> tuple[list, list, list]:
        chosen, one, two = key
        units = unit(np.frombuffer(b"".join(g[2] for g in group), number).reshape(len(group), -1))
        side = np.array([g[0] for g in group])
        linked = units @ units.T >= threshold
        if one == two:
            np.fill_diagonal(linked, False)
        else:
            linked &= side[:, None] != side[None, :]
        busy = np.flatnonzero(linked.any(axis=1))
        if not len(busy):
            return [], [], []
        linked = linked[np.ix_(busy, busy)] & ~_seen_before([group[i][3] for i in busy], chosen)
        weights = np.array([group[i][4] for i in busy], np.int64)
        sums = linked @ weights
        a, b = np.nonzero(np.triu(linked))
        roots = _roots(len(busy), a, b)
        names = [group[i][1] for i in busy]
        out = [i for i in range(len(busy)) if sums[i]]
        return [names[i] for i in out], [int(sums[i]) for i in out], [names[roots[i]] for i in out]

    def record(found: list[tuple[list, list, list]]) -> pa.RecordBatch:
        columns = [[x for f in found for x in f[k]] for k in range(3)]
        kinds = (pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_FOUND.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, group, found = None, [], []
        for batch in batches:
            for first in range(0, len(batch), 4096):
                b = batch.slice(first, 4096)
                lists = b.column(7)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                own = np.split(flat, np.cumsum(lists.value_lengths().to_numpy())[:-1])
                keys = zip(*[b.column(k).to_pylist() for k in range(3)])
                rest = zip(*[b.column(k).to_pylist() for k in (3, 4, 6)], own, b.column(5).to_pylist())
                for key, member in zip(keys, rest):
                    if key != held:
                        if len(group) > 1:
                            found.append(compare(held, group))
                        held, group = key, []
                    group.append(member)
            if len(found) > 1000:
                yield record(found)
                found = []
        if len(group) > 1:
            found.append(compare(held, group))
        if found:
            yield record(found)

    keys = ("filter", "one", "two")
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _FOUND)


def near_duplicate_vectors(
    df: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
    shared: float = SHARED, bucket: int = BUCKET, split: int = SPLIT,
) -> DataFrame:
    """One row for each row: its key, ``n_links`` (other rows with a cosine of
    ``threshold`` or more), ``component_id`` (smallest key that links lead to) and ``kept``."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be above 0 and at most 1; got {threshold!r}")
    number = np.float32 if isinstance(df.schema[embedding].dataType.elementType, T.FloatType) else np.float64
    rows = materialise(_read(df, key, embedding))
    classes = rows.where("same is not null").groupBy("same").agg(
        F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = materialise(classes)
    settings = (classes.count(), min(threshold, 1 - 1e-9), shared, bucket)
    decoded = materialise(_decoded(classes, number, settings))
    found = materialise(_verified(_members(decoded, _block_counts(decoded, split)), number, threshold))
    labels = components(found.where("same != root").select(F.col("same").alias("u"), F.col("root").alias("v")).distinct())
    links = found.groupBy("same").agg(F.sum("links").alias("links"))
    named = (
        classes.select("same", "rows", "least").join(links, "same", "left")
        .join(labels.withColumnRenamed("node", "same"), "same", "left")
        .select("same", "least", F.coalesce("component", "same").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"))
    )
    named = materialise(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = join_distinct(named, least, "component", how="left").select("same", "links", "component_id")
    out = join_distinct(rows.select("id", "same"), named, "same", how="left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
