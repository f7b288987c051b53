"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one
window). A window occurs in a document only if all its words do, so one necessary
word per window, its prefix under the order by rarity, decides where to look:

1. count the benchmark's words over all documents (the order by rarity);
2. index each window by its rarest word, with the word's offset in the window;
3. at each document word that is an index entry, the offset fixes the only place the
   window can have (positional bound), which must lie inside the document (length
   bound), and the window's words are compared there one by one.

The benchmark is worked off in blocks of about ``block_chars`` characters, so that
what is broadcast has a bound however large the benchmark is. Each block is one
narrow pass over the documents, which carries earlier blocks' spans along: no
document is shuffled, and no key can be hot.

Defined cases: a null or empty text has no words and is never contaminated; an item
without words has no window; items with equal id count once; an item whose id is
null marks words, but is neither listed nor counted; repeated documents each get
their row; with an empty benchmark nothing is hit; a very long text is one list of
words at a time. Columns of the documents that
have an output's name are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.llm.batches import add_columns, folded_words, lean, quoted, texts_of

WINDOW = 10
BLOCK_CHARS = 8_000_000

_OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])
_SPANS = pa.list_(pa.list_(pa.int64()))


def _windows(items: list[tuple[str | None, bytes | None]], window: int) -> dict[tuple[bytes, ...], set]:
    found: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        words = folded_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item)
    return found


def _word_counts(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all documents."""
    if not vocabulary:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        lean()
        known, total = shared.value, Counter()
        for b in batches:
            seen = Counter()
            for t in texts_of(b.column(0)):
                seen.update(folded_words(t))
            for w in seen.keys() & known:
                total[w] += seen[w]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    counts = (
        docs.select(quoted(text).alias("t")).mapInArrow(count, "word binary, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    )
    return {bytes(r["word"]): r["n"] for r in counts}


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _find(words: list[bytes], index: dict, spans: list, items: set) -> None:
    n = len(words)
    for at, word in enumerate(words):
        if word in index:
            for offset, window, owners in index[word]:
                first = at - offset
                end = first + len(window)
                if first >= 0 and end <= n and words[first:end] == window:
                    spans.append([first, end])
                    items.update(owners)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with ``n_words``, ``n_hit``, ``hit_spans`` (word positions, end
    exclusive, disjoint) and ``hit_items`` (ids as strings, sorted)."""
    spark, source = docs.sparkSession, docs
    items = benchmark.select(quoted(item_id).cast("string").alias("item"), quoted(item_text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    for block in range(n_blocks):
        here = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        windows = _windows([(r["item"], r["text"].encode() if r["text"] else None) for r in here.collect()], window)
        counts = _word_counts(source, text, frozenset(w for win in windows for w in win))
        index: dict[bytes, list] = {}
        for win, owners in windows.items():
            offset = min(range(len(win)), key=lambda i: (counts.get(win[i], 0), win[i], i))
            if all(counts.get(w, 0) for w in win):
                index.setdefault(win[offset], []).append((offset, list(win), sorted(o for o in owners if o is not None)))
        docs = _pass(docs, text, spark.sparkContext.broadcast(index), first=block == 0,
                     carry=carry if block == 0 or carry is None else [*carry, *_OUT.names])
    return docs


def _pass(docs: DataFrame, text: str, shared, first: bool, carry: Sequence[str] | None) -> DataFrame:
    def start():
        index = shared.value

        def work(columns):
            before = [([], [])] * len(columns[0]) if first else list(zip(columns[1].to_pylist(), columns[2].to_pylist()))
            n_words, n_hit, all_spans, all_items = [], [], [], []
            for t, (old_spans, old_items) in zip(texts_of(columns[0]), before):
                words, spans, items = folded_words(t), list(old_spans), set(old_items)
                _find(words, index, spans, items)
                spans = _merged(spans)
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in spans))
                all_spans.append(spans)
                all_items.append(sorted(items))
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array(all_spans, _SPANS), pa.array(all_items, pa.list_(pa.string()))]

        return work

    inputs = [text] if first else [text, F.col("hit_spans"), F.col("hit_items")]
    if carry is not None and not first:
        carry = [c for c in carry if c not in _OUT.names]
        carry = carry if text in carry else [*carry, text]
    elif carry is not None and text not in carry:
        carry = [*carry, text]
    return add_columns(docs, inputs, _OUT, start, carry)
