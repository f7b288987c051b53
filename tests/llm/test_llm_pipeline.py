"""The pipeline against the stages' plain versions, each on what the one before kept."""

import pandas as pd
import pytest

import brute
import corpus_pipeline


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mix_sources"]


def test_pipeline(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    given = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, given, sf).collect()}
    left = docs[docs.doc_id.isin(kept)]
    assert not any(brute.quality(t)[5] for t in left.text)
    left = left.assign(text=[k for _, _, k in brute.kept_lines(left.text)])
    groups = brute.groups(list(zip(left.doc_id, left.text)), 5, 80)
    left = left[[groups[i][1] == i for i in left.doc_id]]
    left = left[[not c[4] for c in brute.contaminated(left.text, list(zip(items.item_id, items.text)))]]
    sizes = left.assign(n=[len(brute.SPACED.findall(t)) for t in left.text]).groupby("source").n.sum().to_dict()
    want = brute.targets(sizes)
    found = corpus_pipeline.run(spark, sf).toPandas()
    text = dict(zip(left.doc_id, left.text))
    assert len(found) == found.doc_id.nunique() and set(found.doc_id) <= set(text)
    for r in found.itertuples():
        assert (r.text, r.n_chars, r.source_size) == (text[r.doc_id], len(r.text), sizes[r.source])
        assert r.target == pytest.approx(want[r.source])
        assert r.taken in (r.size, 2 * r.size, 3 * r.size)
    taken = found.groupby("source").taken.sum()
    for s, target in want.items():
        assert abs(taken.get(s, 0) - target) <= left[left.source == s].text.str.split().str.len().max()
