"""The registered queries against the plain versions, on whole tables."""

import pandas as pd
import pytest

import brute
from pulsewide.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def table(sf):
    return lambda name: pd.read_parquet(f"{sf}/{name}.parquet")


def rows(spark, sf, name):
    return [tuple(r) for r in QUERIES[name](spark, sf).collect()]


def by_id(found):
    out = {r[0]: r[1:] for r in found}
    assert len(out) == len(found)
    return out


def test_numbered_queries():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_html(spark, sf, table):
    """Pages of the table hold their article in ``article``, in h1 and p."""
    import html
    import re

    found = by_id(rows(spark, sf, "op1_html"))
    for p in table("pages").itertuples():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert found[p.page_id] == (p.url, text, len(text))


def test_licenses(spark, sf, table):
    found = by_id(rows(spark, sf, "op2_licenses"))
    for d in table("documents").itertuples():
        n, base, first, last, labels = brute.licenses(d.text)
        got = found[d.doc_id]
        assert got[:5] == (n, base, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(got[5].split(","))
        assert 0 <= got[6] <= 1


def test_quality(spark, sf, table):
    found = by_id(rows(spark, sf, "op3_quality"))
    for d in table("documents").itertuples():
        want = brute.quality(d.text)
        assert found[d.doc_id][:6] == want
        assert not (want[5] and found[d.doc_id][6])
    labels = table("labels").set_index("doc_id").quality
    good = [found[i] for i in labels[labels == 1].index if not found[i][5]]
    bad = [found[i] for i in labels[labels == 0].index]
    assert all(r[6] for r in good)
    assert sum(not r[6] for r in bad) >= 0.8 * len(bad)


def test_urls(spark, sf, table):
    found = by_id(rows(spark, sf, "op4_urls"))
    for p in table("pages").itertuples():
        host, path, rule, verdict = brute.url(p.url)
        got = found[p.page_id]
        assert got[:3] == (host, path, rule)
        assert got[3] == verdict if verdict else got[3] in ("allow", "block")


def test_pii(spark, sf, table):
    found = by_id(rows(spark, sf, "op5_pii"))
    for d in table("documents").itertuples():
        *counts, spans = brute.pii(d.text)
        got = found[d.doc_id]
        assert got[:5] == (*counts, brute.sha(spans))
        assert set(filter(None, spans.split(","))) <= set(got[5].split(","))


def test_jaccard(spark, sf, table):
    docs = table("documents")
    assert by_id(rows(spark, sf, "op6_jaccard")) == brute.groups(list(zip(docs.doc_id, docs.text)))


def test_decontaminate(spark, sf, table):
    docs, items = table("documents"), table("benchmark")
    want = brute.contaminated(docs.text, list(zip(items.item_id, items.text)))
    assert by_id(rows(spark, sf, "op7_decontaminate")) == dict(zip(docs.doc_id, want))


def test_lines(spark, sf, table):
    docs = table("documents")
    want = [(n, gone, brute.sha(kept)) for n, gone, kept in brute.kept_lines(docs.text)]
    assert by_id(rows(spark, sf, "op8_lines")) == dict(zip(docs.doc_id, want))


def test_chat(spark, sf, table):
    found = by_id(rows(spark, sf, "op9_chat"))
    turns = table("conversations").sort_values(["conv_id", "turn"])
    want = {c: brute.conversation(list(zip(g.role, g.text))) for c, g in turns.groupby("conv_id")}
    said = "</s>[INST] ok [/INST]"
    want[-1] = brute.conversation([("user", said), ("assistant", said)])
    assert {c: r[:4] for c, r in found.items()} == want


def test_mixing(spark, sf, table):
    docs = table("documents")
    size = {d.doc_id: len(brute.SPACED.findall(d.text or "")) for d in docs.itertuples()}
    source = dict(zip(docs.doc_id, docs.source))
    sizes = pd.Series(size).groupby(pd.Series(source)).sum().to_dict()
    want = brute.targets(sizes)
    found = by_id(rows(spark, sf, "op10_mixing"))
    taken = dict.fromkeys(sizes, 0)
    for i, (n, source_size, target, words) in found.items():
        s = source[i]
        assert (n, source_size) == (size[i], sizes[s])
        assert target == pytest.approx(want[s], rel=1e-12)
        assert words in (0, n, 2 * n, 3 * n)
        taken[s] += words
    for s, words in taken.items():
        largest = max(size[i] for i in size if source[i] == s)
        assert abs(words - want[s]) <= largest
    assert by_id(rows(spark, sf, "op10_mixing")) == found
