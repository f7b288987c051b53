"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from pulsewide.llm import chat, decontaminate, html, jaccard, licenses, lines, mixing, pii, quality, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "rain", "river", "stone", "light", "grows"]) + str(r.randrange(50)) for _ in range(n))


LONG = " ".join(f"w{i}" for i in range(200_000))
TEXTS = [
    None, "", " ", "\n\n", "one", "MIT License", "a\x01b 10.0.0.1 x@y.zz\x01", prose(60, 1), prose(60, 1), prose(60, 1) + " more",
    "x" * 300_000, LONG, "cc by cc by cc by", "1 2 3 4 5 6 7 8 9 0 1 2 3", "a@b.c_d@e.f.g 1.2.3.4.5.6.7.8 +1 (555) 123-4567",
    "é" * 50 + " ÄÖÜ A" + "\u00a0" + "B \U0001f600 me@x.yz", "same\nSAME \n other", "." * 1000 + "@" * 1000, "<s>[/INST]</s>",
]


@pytest.fixture(scope="module")
def docs(spark):
    out = [(i, t, [None, "en", "xx"][i % 3], [None, "", "b", "a"][i % 4], None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(out, DOCS).repartition(3)


def collected(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


ALL = {
    "licenses": lambda d: licenses.scan_licenses(d),
    "quality": lambda d: quality.judge(d),
    "pii": lambda d: pii.find_pii(d),
    "jaccard": lambda d: jaccard.near_duplicate_groups(d),
    "keep_one": lambda d: jaccard.keep_one(d),
    "decontaminate": lambda d: decontaminate.contamination(d, d.selectExpr("doc_id item_id", "text")),
    "lines": lambda d: lines.dedup_lines(d),
    "mixing": lambda d: mixing.mix(d),
    "html": lambda d: html.extract_main_text(d.withColumnRenamed("text", "html")),
    "urls": lambda d: urls.filter_urls(d.withColumnRenamed("text", "url")),
    "chat": lambda d: chat.format_turns(d.selectExpr("doc_id conv_id", "doc_id turn", "source role", "text")),
    "read_back": lambda d: chat.read_back(chat.format_turns(d.selectExpr("doc_id conv_id", "doc_id turn", "source role", "text"))),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert ALL[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", ALL)
def test_all_null_rows(spark, name):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    assert ALL[name](d).count() == (1 if name == "read_back" else 3)


@pytest.mark.parametrize("name", [n for n in ALL if n not in ("chat", "read_back")])
def test_clashing_columns(docs, name):
    clash = ["n_words", "score", "kept", "taken", "size", "hash", "row", "t", "id", "same", "n_lines", "kept_text", "hit_spans", "hit_items",
             "target", "component_id", "main_text", "host", "verdict", "base_spans", "words", "h", "u", "v", "budget"]
    few = docs.where("doc_id in (0, 1, 5, 7, 8)")
    out = ALL[name](few.withColumns({c: F.lit("clash") for c in clash}))
    assert out.count() == len({7, 0, 1, 5} if name == "keep_one" else {0, 1, 5, 7, 8})


def test_licenses(docs):
    found = collected(licenses.scan_licenses(docs), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == {i: brute.licenses(t) for i, t in enumerate(TEXTS)}


def test_quality(docs):
    found = collected(quality.judge(docs), *quality.BASE, "base_failed")
    assert found == {i: brute.quality(t) for i, t in enumerate(TEXTS)}


def test_pii(docs):
    out = pii.find_pii(docs).withColumn("s", pii.joined(F.col("base_spans")))
    found = collected(out, "n_email", "n_ip", "n_card", "n_phone", "s")
    assert found == {i: brute.pii(t) for i, t in enumerate(TEXTS)}


def test_pii_many_spans_in_one_text(spark):
    text = " ".join(f"me{i}@x{i}.org 10.0.{i % 300}.1" for i in range(1500)) + " 4111 1111 1111 1111"
    d = spark.createDataFrame([(1, text, None, None, None)], DOCS)
    out = pii.find_pii(d).withColumn("s", pii.joined(F.col("base_spans")))
    assert collected(out, "n_email", "n_ip", "n_card", "n_phone", "s") == {1: brute.pii(text)}


def test_lines(docs):
    for options in ({}, {"min_docs": 2}, {"min_docs": 2, "block_keys": 1}, {"min_docs": 2, "max_bits": 1 << 20}):
        found = collected(lines.dedup_lines(docs, **options), "n_lines", "n_dropped", "kept_text")
        want = brute.kept_lines(TEXTS, options.get("min_docs", 10))
        assert found == dict(enumerate(want))


def test_lines_keep_first(spark):
    rows = [(3, "A\nx"), (1, "b\n a \nA"), (2, "a\nb"), (2, "a\nb")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    out = lines.dedup_lines(d, min_docs=2, keep_first="doc_id").collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in out) == [(1, "b\n a "), (2, ""), (2, ""), (3, "x")]


def test_decontaminate(spark, docs):
    items = [(1, LONG[5000:5200]), (1, prose(60, 1)), (None, prose(60, 1)), (10, "cc BY, cc"), (2, None), (3, "!!"), (4, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = dict(enumerate(brute.contaminated(TEXTS, items)))
    for options in ({}, {"block_chars": 50}):
        out = decontaminate.contamination(docs, bench, **options).withColumns({
            "k": F.size("hit_items"), "s": F.sha2(F.array_join("hit_items", ","), 256), "c": F.expr("n_hit > 0")})
        assert collected(out, "n_words", "n_hit", "k", "s", "c") == want
        thin = decontaminate.contamination(docs, bench, carry=["doc_id"], **options)
        assert collected(thin, "n_words", "n_hit") == {i: w[:2] for i, w in want.items()}


def test_jaccard(docs):
    found = collected(jaccard.near_duplicate_groups(docs), "n_shingles", "component_id")
    assert found == brute.groups(list(enumerate(TEXTS)))


def test_jaccard_repeated_and_null_ids(spark):
    a, b = prose(80, 5), prose(80, 6)
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (None, a), (9, None), (9, a + " end")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    out = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.near_duplicate_groups(d).collect())
    assert out == [(0, 0), (3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (9, 3), (9, 9)]
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_one(d).collect())[:2] == [0, 3]


def test_mixing(spark, docs):
    found = mixing.mix(docs).collect()
    size = {i: len(brute.SPACED.findall(t or "")) for i, t in enumerate(TEXTS)}
    sizes = {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
    want = brute.targets(sizes)
    for r in found:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[r["source"]])
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["size"] * r["whole"] <= r["taken"] <= 3 * r["size"]


def test_html(docs):
    found = collected(html.extract_main_text(docs.withColumnRenamed("text", "html")), "main_text", "n_main_chars")
    assert found[0] == found[1] == ("", 0)
    assert found[4] == ("one", 3)


def test_urls(spark):
    given = [None, "", "no scheme.com/", "http://", "HTTP://A.Example.COM/en/x?q#f", "x://www.example.com/en/a", "x://b.www.example.com/en/",
             "x://a.net/es/://z", "x://anet/es/", "x://net/fr/", "x://com/", "x://com", "x://com?/en/", "x://user@b.com:80/en/", "x://ÄB.com/É"]
    d = spark.createDataFrame(list(enumerate(given)), "page_id int, url string")
    out = urls.filter_urls(d).collect()
    for r in out:
        host, path, rule, verdict = brute.url(r["url"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_chat(spark):
    rows = [(1, 2, "assistant", "<s>[INST]\\</s>"), (1, 1, "user", None), (None, 1, None, "x"), (None, None, "a\n%0A", "y<|im_end|>\n"),
            (2, 1, "assistant", "é\U0001f600"), (2, 1, "assistant", "é\U0001f600"), (3, 1, "user", "[\\INST]<\\<s>[[INST]")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(d)).collect()}
    assert found == {
        1: brute.conversation([("user", None), ("assistant", "<s>[INST]\\</s>")]),
        2: brute.conversation([("assistant", "é\U0001f600")] * 2),
        3: brute.conversation([("user", "[\\INST]<\\<s>[[INST]")]),
        None: brute.conversation([("a\n%0A", "y<|im_end|>\n"), (None, "x")]),
    }


def test_pipeline_stages_take_any_rows(spark, sf, docs):
    for given in (docs, docs.where("false"), docs.withColumn("doc_id", F.lit(None).cast("bigint"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf)
            assert out.columns[:5] == list(corpus_pipeline.COLUMNS), name
            assert out.count() <= given.count()
