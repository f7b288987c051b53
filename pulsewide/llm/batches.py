"""Shared helpers of the operators: Arrow batches, bounded folds, words, native let."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: A-Z become a-z; ASCII that is neither letter nor digit becomes a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def folded_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


#: Rows whose texts are Python objects at one time.
_SLICE = 256


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, of a slice of its rows at a time."""
    for at in range(0, len(column), _SLICE):
        yield from as_bytes(column.slice(at, _SLICE))


def lean() -> None:
    """Let Arrow give freed batches back to the system: called once in a task, so that a
    worker that lives on does not keep its largest batch."""
    pa.set_memory_pool(pa.system_memory_pool())


def add_columns(
    df: DataFrame,
    inputs: Sequence[str | Column],
    outputs: T.StructType,
    start: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Columns made batch by batch in Python, beside the carried ones.

    ``start`` runs once per task and returns the function that turns a batch's
    input arrays into its output arrays. ``carry`` defaults to all columns; one
    that has the name of an output gives way to it. Rows never meet, so a lost
    executor costs its own tasks only.
    """
    carried = [c for c in (df.columns if carry is None else carry) if c not in outputs.names]
    sent = [quoted(c).alias(f"c{i}") for i, c in enumerate(carried)]
    positions = []
    for x in inputs:
        if isinstance(x, str) and x in carried:
            positions.append(carried.index(x))
        else:
            positions.append(len(sent))
            sent.append((quoted(x) if isinstance(x, str) else x).alias(f"i{len(sent)}"))
    n = len(carried)
    made = [f"o{i}" for i in range(len(outputs))]
    schema = T.StructType(
        [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carried)]
        + [T.StructField(m, f.dataType) for m, f in zip(made, outputs)]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        work = start()
        for b in batches:
            columns = b.columns
            new = work([columns[i] for i in positions])
            yield pa.RecordBatch.from_arrays([*columns[:n], *new], names=names)

    out = df.select(*sent).mapInArrow(run, schema)
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)],
        *[F.col(m).alias(f.name) for m, f in zip(made, outputs)],
    )


_CHUNK = 1 << 16
_PART = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("data", T.BinaryType())])


def fold(
    df: DataFrame,
    inputs: Sequence[str],
    dtypes: Sequence[str],
    length: int,
    start: Callable[[list[np.ndarray]], Callable[[list[pa.Array]], None]],
    merge: Callable[[list[np.ndarray], list[np.ndarray]], None],
    keep: Sequence[int],
) -> list[np.ndarray]:
    """Arrays of a fixed length, filled by every task and merged into one.

    Each task fills its own arrays, splits them into chunks and compresses these;
    the chunks are dealt out by number and merged as they stream by, so that a
    merging task holds its own chunks alone, whatever the number of tasks. Only
    the arrays named by ``keep`` come to the driver: ``length`` bounds them.
    """
    dtypes = list(dtypes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        arrays = [np.zeros(length, t) for t in dtypes]
        update = start(arrays)
        for b in batches:
            update(b.columns)
        for c in range(0, length, _CHUNK):
            parts = [a[c : c + _CHUNK] for a in arrays]
            if any(p.any() for p in parts):
                data = zlib.compress(b"".join(p.tobytes() for p in parts), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c // _CHUNK], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "data"]
                )

    def unpack(chunk: int, data: bytes, which: Sequence[str]) -> list[np.ndarray]:
        size = min(_CHUNK, length - chunk * _CHUNK)
        raw, at, out = zlib.decompress(data), 0, []
        for t in which:
            step = size * np.dtype(t).itemsize
            out.append(np.frombuffer(raw[at : at + step], t).copy())
            at += step
        return out

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = unpack(chunk, data, dtypes)
                if chunk in held:
                    merge(held[chunk], parts)
                else:
                    held[chunk] = parts
        for chunk, parts in held.items():
            data = zlib.compress(b"".join(parts[k].tobytes() for k in keep), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "data"]
            )

    n_chunks = -(-length // _CHUNK)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        df.select(*[quoted(c).alias(f"i{i}") for i, c in enumerate(inputs)])
        .mapInArrow(build, _PART)
        .repartition(max(1, min(n_chunks, parts)), "chunk")
    )
    kept = [dtypes[k] for k in keep]
    whole = [np.zeros(length, t) for t in kept]
    for row in dealt.mapInArrow(gather, _PART).collect():
        at = row["chunk"] * _CHUNK
        for array, part in zip(whole, unpack(row["chunk"], bytes(row["data"]), kept)):
            array[at : at + len(part)] = part
    return whole


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row; a plain reference inside a
    lambda would compute it again for every element."""
    return F.transform(F.array(value), body)[0]


def count_of(array: Column) -> Column:
    return F.size(array).cast("bigint")
