"""Prefix trie of conversations by fixed-length block hashing.

Conversations are rebuilt first: a conversation takes its first turns from the one whose
number ends its hundred, as many as its checksum says. Turns then fall into blocks of
``BLOCK``. A block's digests meet block by block: conversations with the same digests of all
blocks so far are one class, whatever their number, and only a class's count, smallest
member and one copy of its turn digests go on. Where a class's parent has no other child,
all turns of the block have the same members and the block is a plain chain of nodes; only
where siblings diverge are they regrouped turn by turn, by class and not by conversation.

A node is named by 128 bits, the exclusive or of one MD5 value for each of its blocks (the
last one may be part of a block), which holds the block's number and its turn digests. So
names of prefixes are running totals along a conversation. Running totals, here and of
positions and token sums, are made by ranges: rows are sorted over all conversations, each
range adds up its own, and one total a range is passed on. So a conversation with a third of
all turns is many tasks' work. Texts are left behind in the first step.

Sums over subtrees need no walk. A node's cost is put on its smallest member; a node's
subtree then costs what its members carry, less what its own smallest member carries above
it. Leaves are counted likewise, one for the smallest member of each.

The members that end at one node are hashed in order in one task, with constant memory: a
digest of ids is sequential work.

Defined cases: null roles and texts are empty; rows of equal turn, null first, are in the
order of their digests; repeated rows are turns of their own; rows of a null conversation
are of none; a conversation may be left without turns, and is then a member of the root
alone; an empty table gives no node, not even the root. Very long texts are hashed where
they are read. Only the four columns named are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.llm.batches import lean, quoted
from pulsewide.operators.running import running
from pulsewide.operators.salting import join_distinct
from pulsewide.session import materialise

BLOCK = 4
HUNDRED, HEADS = 100, 6

NODE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_NODES = T.ArrayType(NODE)


def _both(x: Column, y: Column) -> Column:
    return F.struct(x["a"].bitwiseXOR(y["a"]).alias("a"), x["b"].bitwiseXOR(y["b"]).alias("b"))


def _root() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))


def rebuilt(turns: DataFrame, *, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, as position, digest and code points, and one row
    for each conversation with its number of turns."""
    said, words = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role, text))
    slim = turns.select(
        quoted(conv).cast("bigint").alias("conv_id"), quoted(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, words))).alias("digest"),
        F.length(words).cast("bigint").alias("n_chars"),
    ).where("conv_id is not null")
    slim = materialise(slim.withColumns({"position": F.lit(1).cast("bigint"), "tie": F.monotonically_increasing_id()}))
    slim = slim.withColumn("order", F.col("digest"))
    placed = running(slim, "conv_id", ["turn", "order", "tie"], adds=["position"])
    convs = placed.groupBy("conv_id").agg(F.max("position").alias("n_own")).select(
        "conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))
    first = placed.where((F.col("conv_id") % HUNDRED == 0) & (F.col("position") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("position", "digest", "n_chars"))).alias("heads"))
    head = F.slice(F.coalesce("heads", F.array().cast(first.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int"))
    convs = convs.join(first, "base", "left").withColumn("head", head)  # a base has few conversations
    n_turns = F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    convs = materialise(convs.select("conv_id", "h", "head", n_turns.cast("bigint").alias("n_turns")))
    own = join_distinct(placed, convs.select("conv_id", "h", F.size("head").alias("n_head"), "n_turns"), "conv_id", "inner").where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("n_head")).alias("position"), "digest", "n_chars", "n_turns")
    taken = convs.select("conv_id", "n_turns", F.inline("head")).select("conv_id", "position", "digest", "n_chars", "n_turns")
    return own.union(taken), convs.select("conv_id", "n_turns")


_BLOCK = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("block", T.LongType()), T.StructField("ends", T.BooleanType()),
    T.StructField("names", _NODES), T.StructField("chars", T.ArrayType(T.LongType())),
    T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
])


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """One row for each conversation and block: ``names`` of its turns within the block,
    their code points, and the whole block's name as ``a`` and ``b``."""
    numbered = turns.withColumn("block", F.floor((F.col("position") - 1) / size).cast("bigint"))
    grouped = numbered.groupBy("conv_id", "block").agg(  # at most ``size`` turns
        (F.max("position") == F.max("n_turns")).alias("ends"),
        F.array_sort(F.collect_list(F.struct("position", "digest", "n_chars"))).alias("turns"))
    grouped = grouped.select("conv_id", "block", "ends", "turns.digest", F.col("turns.n_chars").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            names, ends = [], [0]
            for block, digests in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                hashed = hashlib.md5(b"%d:" % block)
                for d in digests:
                    hashed.update(d)
                    names.append(hashed.digest())
                ends.append(len(names))
            numbers = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            listed = pa.StructArray.from_arrays([pa.array(numbers[:, 0]), pa.array(numbers[:, 1])], names=["a", "b"])
            last = numbers[np.array(ends[1:], np.int64) - 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed), b.column(4),
                 pa.array(last[:, 0]), pa.array(last[:, 1])], names=_BLOCK.names)

    return grouped.mapInArrow(run, _BLOCK)


def _by_turn(classes: DataFrame, size: int, measures: Sequence[str]) -> DataFrame:
    """Nodes of all classes: chains as they are, diverging siblings regrouped turn by turn."""
    before = F.when(F.col("k") == 0, F.col("parent")).otherwise(_both(F.col("parent"), F.get("names", F.col("k") - 1)))
    one = classes.select("*", F.posexplode("chars").alias("k", "n_chars"))
    one = one.select(
        _both(F.col("parent"), F.get("names", F.col("k"))).alias("node"), before.alias("above"),
        (F.col("block") * size + F.col("k") + 1).alias("depth"), "n_chars", "children", *measures)
    how = {m: (F.min if m == "least" else F.sum)(m).alias(m) for m in measures}
    several = one.where("children > 1").groupBy("node").agg(
        F.first("above").alias("above"), F.first("depth").alias("depth"), F.first("n_chars").alias("n_chars"), *how.values())
    return one.where("children = 1").drop("children").union(several)


def _end_digests(ends: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node, in order."""
    schema = T.StructType([T.StructField("node", NODE), T.StructField("ends_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        current, digest, done = None, None, []

        def record() -> pa.RecordBatch:
            names = pa.array([{"a": a, "b": b} for (a, b), _ in done], pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            return pa.RecordBatch.from_arrays([names, pa.array([d for _, d in done], pa.string())], names=schema.names)

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = (a, b), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            if len(done) >= 10_000:
                yield record()
                done = []
        if digest is not None:
            done.append((current, digest.hexdigest()))
            yield record()

    dealt = ends.select("node.a", "node.b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    return dealt.mapInArrow(run, schema)


def prefix_trie(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row for each node: its ``node`` name and that of its parent, smallest member
    ``conv_id``, ``depth``, ``parent_conv_id``, members, children, leaves of its subtree,
    code points its subtree saves, and the digest of the members that end at it."""
    sequence, convs = rebuilt(turns, conv=conv, turn=turn, role=role, text=text)
    own = F.element_at("names", -1)
    blocks = materialise(_blocks(sequence, block)).withColumn("order", F.col("block"))
    blocks = running(blocks, "conv_id", ["order"], xors=["a", "b"])
    blocks = blocks.withColumn("node", F.struct("a", "b")).withColumn("parent", _both(F.col("node"), own))
    blocks = materialise(blocks.drop("a", "b"))

    classes = materialise(blocks.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("least"),
        *[F.first(c).alias(c) for c in ("block", "parent", "names", "chars")]))
    siblings = classes.groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    classes = materialise(join_distinct(classes, siblings, "parent", "inner"))
    nodes = _by_turn(classes, block, ["n_convs", "least"])
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("least")).where("n_convs > 0").select(
        _root().alias("node"), F.lit(None).cast(NODE).alias("above"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("n_chars"), "n_convs", "least")
    nodes = materialise(nodes.unionByName(root))
    kids = nodes.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    cost = (F.col("n_convs") - 1) * F.col("n_chars")
    nodes = materialise(nodes.join(kids, "node", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("bigint"), "cost": cost}))

    carried = nodes.groupBy(F.col("least").alias("conv_id")).agg(
        F.sum("cost").alias("carried"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("bigint").alias("leaves"))
    carried = materialise(carried)
    sums = join_distinct(blocks.select("conv_id", "node"), carried, "conv_id", "inner").groupBy("node").agg(
        F.sum("carried").alias("carried"), F.sum("leaves").alias("leaves"))
    sums = _by_turn(classes.drop("n_convs", "least").join(sums, "node"), block, ["carried", "leaves"]).select("node", "carried", "leaves")
    everything = carried.agg(F.sum("carried").alias("carried"), F.sum("leaves").alias("leaves")).where("leaves is not null")
    sums = sums.union(everything.select(_root(), "carried", "leaves"))
    # of what a node's smallest member carries, the part above the node
    above = running(
        nodes.where("n_convs > 1").select("least", "depth", "node", "cost", F.col("cost").alias("upto")), "least", ["depth"], adds=["upto"]
    ).select("node", (F.col("upto") - F.col("cost")).alias("over"))

    ended = blocks.where("ends").select("node", "conv_id").union(convs.where("n_turns = 0").select(_root(), "conv_id"))
    digests = _end_digests(ended)
    parents = nodes.select(F.col("node").alias("above"), F.col("least").alias("parent_conv_id"))
    out = join_distinct(nodes, parents, "above", "left")
    out = out.join(sums, "node").join(above, "node", "left").join(digests, "node", "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("carried") - F.coalesce("over", "carried")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "node", F.col("above").alias("parent_node"),
    )
