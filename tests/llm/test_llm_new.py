"""Alignment, prefix trie and vector near-duplicates: plain versions, awkward rows, hot groups."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from pulsewide.llm import alignment, embeddings, trie
from pulsewide.llm.catalog import QUERIES

ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
TURNS = "conv_id bigint, turn bigint, role string, text string"
CLASH = ["row", "pair", "n", "a", "b", "node", "filter", "same", "at", "part", "tops", "n_a", "row of text"]


def ordered(rows):
    return sorted(rows, key=lambda t: tuple((x is not None, x) for x in t))


@pytest.fixture(scope="module")
def encoders():
    return brute.tokenizers()


def test_alignment_of_the_table(spark, sf, encoders):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    found = {r[0]: tuple(r[1:]) for r in QUERIES["op11_alignment"](spark, sf).collect()}
    texts = [t if isinstance(t, str) else None for t in docs.text]
    assert found == dict(zip(docs.doc_id, brute.alignment(texts, *encoders)))
    assert sum(f[2] for f in found.values()) > 10_000


AWKWARD = [
    None, "", " ", "   ", "a  b", "<|endoftext|>", "</s><s> x", "<0x41> <unk>", "▁", "a▁b", "é \U0001f600\x00\r\n\tend", "x" * 30_000,
    "rain and rivers, rain and rivers", "rain and rivers, rain and rivers", " leading", "trailing ", "日本語のテキスト", "́a​",
]


def test_alignment_of_awkward_texts(spark, encoders):
    # the long word is one row; its links are counted by the same plain version
    docs = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id int, text string").repartition(3)
    want = dict(enumerate(brute.alignment([t if t is None or len(t) < 9000 else t[:600] for t in AWKWARD], *encoders)))
    short = docs.withColumn("text", F.when(F.length("text") < 9000, F.col("text")).otherwise(F.substring("text", 1, 600)))
    for hot in (alignment.HOT_PAIRS, 12, 0):
        out = alignment.align(short, carry=["doc_id"], hot_pairs=hot).collect()
        assert {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in out} == want
    whole = {r["doc_id"]: r for r in alignment.align(docs).collect()}
    assert whole[11]["n_links"] == whole[11]["n_a"] + whole[11]["n_b"] - whole[11]["n_groups"] > 3000
    for r in whole.values():
        assert sum(g["n_a"] for g in r["groups"]) == len(r["a_ids"]) == r["n_a"]
        assert sum(g["n_b"] for g in r["groups"]) == len(r["b_ids"]) == r["n_b"]


def test_groups_are_the_finest():
    assert alignment.common_groups([1, 2, 3], [3, 1, 2]) == ([2, 3], [1, 3])
    assert alignment.common_groups([4], [1, 1, 1, 1]) == ([1], [4])
    assert alignment.common_groups([], []) == ([], [])


def test_plain_texts_are_encoded_alike_in_both_ways():
    """The fast way for plain texts against the tokenizer itself, for every plain character."""
    with open(alignment.BYTE_BPE, "rb") as f:
        fast = alignment.ByteBpe(f.read())
    r = random.Random(2)
    plain = [chr(c) for c in range(0x250)]
    texts = [f"a{c}b {c}{c} 1{c}2 {c}'{c}s\n{c}\t {c}" for c in plain]
    texts += ["".join(r.choice(plain) for _ in range(300)) for _ in range(300)] + ["".join(r.choice("ab' \n1.é") for _ in range(400)) for _ in range(300)]
    texts += [" " * 5000, "x" * 20_000, "<|endoftext|> '", "日本語", "x" * 140_000]
    found = fast.encode(texts)
    assert fast._by_rank is not None
    fast._by_rank = None
    assert found == fast.encode(texts)


def test_trie_of_the_table(spark, sf):
    turns = pd.read_parquet(f"{sf}/conversations.parquet")
    rows = [(int(c), int(t), r, x) for c, t, r, x in turns[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    assert ordered(tuple(r) for r in QUERIES["op12_trie"](spark, sf).collect()) == ordered(brute.trie(rows))


def random_turns(seed, convs, most):
    r = random.Random(seed)
    return [
        (c, r.choice([None, t, t, t]), r.choice(["user", None]), r.choice(["a", "bb", None, "", "ccc"]))
        for c in convs for t in range(r.randrange(most))
    ]


@pytest.mark.parametrize("block", [1, 4])
def test_trie_of_awkward_conversations(spark, block):
    rows = random_turns(block, [*range(60), *range(100, 140), 205, 206, -5, -100], 12)
    rows += [(c, t, "user", f"same {t}") for c in (300, 301, 302) for t in range(120)]
    rows += [(None, 1, "user", "x"), *rows[:15], (400, None, None, None), (401, 1, "u", "w" * 200_000)]
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(7)
    out = trie.prefix_trie(turns, block=block).collect()
    assert ordered(tuple(r[c] for c in TRIE) for r in out) == ordered(brute.trie(rows))
    assert len({r["node"] for r in out}) == len(out)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    """The long one spans ranges of the sort; the equal ones end at one node."""
    rows = [(7, t % 900, "user", f"t{t}") for t in range(3000)] + [(c, 0, "user", "hello") for c in range(1000, 1600)]
    out = trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert ordered(tuple(r[c] for c in TRIE) for r in out) == ordered(brute.trie(rows))


def test_vectors_of_the_table(spark, sf):
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    rows = [(int(i), list(map(float, v))) for i, v in zip(table.vec_id, table.embedding)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op13_embeddings"](spark, sf).collect()}
    assert found == dict(zip([i for i, _ in rows], brute.vectors(rows)))


def near(rng, v, cosine):
    side = rng.standard_normal(len(v))
    side -= side @ v / (v @ v) * v
    return v / np.linalg.norm(v) * cosine + side / np.linalg.norm(side) * math.sqrt(1 - cosine**2)


@pytest.mark.parametrize("dim, element, split", [(1, "double", 40), (3, "double", 1024), (24, "float", 40), (300, "double", 1024)])
def test_recall_against_brute_force(spark, dim, element, split):
    """Pairs just over the threshold, groups of near copies and pairs just below it."""
    rng = np.random.default_rng(dim)
    vectors = list(rng.standard_normal((400, dim)))
    if dim > 1:
        for v in vectors[:150]:
            vectors.append(near(rng, v, rng.uniform(0.901, 0.93)))
            vectors.append(near(rng, v, rng.uniform(0.85, 0.899)))
        vectors += [near(rng, vectors[0], 0.995) for _ in range(150)]
    vectors += [v * 3 for v in vectors[:40]]
    kind = np.float32 if element == "float" else np.float64
    rows = [(i, [float(x) for x in v.astype(kind)]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{element}>").repartition(4)
    want = brute.vectors(rows)
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicate_vectors(df, split=split).collect()}
    assert all(found[i] <= n for i, (n, _) in enumerate(want))  # none below the threshold, none twice
    assert sum(found.values()) >= 0.99 * sum(n for n, _ in want)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (5, [1.0, 0.001]), (5, [1.0, 0.001]), (5, [0.0, 1.0]), (6, None), (7, []), (8, [0.0, 0.0]),
            (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (None, [1.0, 0.0]), (12, [1.0]), (13, [5.0]), (14, [-5.0]),
            (15, [1e300, 1e300]), (16, [1e-300, 1e-300]), (17, [0.0, -0.0, 1.0]), (18, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in CLASH})
    out = ordered((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df).collect())
    assert out == ordered([
        (None, 0, None), (1, 3, 1), (3, 3, 1), (5, 3, 1), (5, 3, 1), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10),
        (11, 0, 11), (12, 1, 12), (13, 1, 12), (14, 0, 14), (15, 1, 15), (16, 1, 15), (17, 1, 17), (18, 1, 17)])
    kept = {(r["vec_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert (1, True) in kept and (3, False) in kept and (None, False) in kept


def test_one_group_may_hold_most_vectors(spark):
    """Equal vectors are one class; near ones are cut into blocks and each pair counts once."""
    rng = np.random.default_rng(8)
    middle = rng.standard_normal(32)
    vectors = [middle] * 500 + [near(rng, middle, 0.99) for _ in range(500)] + list(rng.standard_normal((200, 32)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(6)
    units = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (units @ units.T >= 0.9).sum(axis=1) - 1
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df, split=64).collect()}
    assert [found[i][0] for i in range(len(rows))] == want.tolist()
    assert all(found[i][1] == 0 for i in range(1000))


def test_empty_tables(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id int, text string")
    assert [tuple(r) for r in alignment.align(nulls, carry=[]).select(*ALIGNED).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert trie.prefix_trie(spark.createDataFrame([(None, None, None, None)], TURNS)).count() == 0
