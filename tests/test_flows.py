"""The three flows end to end on attribute-value files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.operators.profile import columns_with, cohorts, null_counts, split_by_activity
from pulsewide.operators.pivot import active_history, load_wide
from pulsewide.operators.salting import join_distinct
from pulsewide.plans import flows
from pulsewide.sources import eav as SRC
from pulsewide.streaming.score import read_wide_stream, score_stream, write_scores

DELAY = S.DELAY_COL
BRACKET = "transactionalTravelTripDelayDurationBracketV0Last30d"
PRICE, PRICE_COPY = "transactionalLastTicketPriceInEurosV0", "priceCopyV0Last30d"
OPTIONS, AGE = "optionsV0Last30d", "userProfileAgeGroupV0"
TYPES = {
    DELAY: S.NUMERIC, BRACKET: S.CATEGORICAL, PRICE: S.NUMERIC, PRICE_COPY: S.NUMERIC,
    OPTIONS: S.MULTI_CATEGORICAL, AGE: S.CATEGORICAL,
}
PARAMS = {"learning_rate": 0.1, "num_leaves": 8, "min_child_samples": 5, "colsample_bytree": 1.0}


def customers(n, scored, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        travels = scored or i % 5 == 0
        delay = float(np.round(rng.exponential(8), 2))
        price = float(np.round(rng.uniform(5, 90), 2))
        bad = (delay > 12 or price > 70) != (rng.random() < 0.05)
        score = "0" if bad else ("7" if i % 2 else "10")
        if i % 50 == 49:
            score = "5"
        head = [f"c{i}", f"r{i}", f"2024-{1 + i % 12:02d}-15T00:00:00Z"] + ([score] if scored else [])
        cells = [(AGE, ["young", "old", ""][i % 3]), (OPTIONS, "seat||bike" if i % 4 else "")]
        if travels:
            cells += [(DELAY, str(delay)), (BRACKET, "long" if delay > 10 else "short")]
        if travels or i % 5 == 1:
            cells += [(PRICE, str(price))] + ([(PRICE_COPY, str(price * 2))] if i % 3 else [])
        rows += [[*head, key, value] for key, value in cells]
    return rows


def csv(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join(r) for r in rows]]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("eav")
    return (
        csv(folder / "train.csv", S.TRAIN_EAV.names, customers(400, True, 1)),
        csv(folder / "live.csv", S.LIVE_EAV.names, customers(300, False, 2)),
    )


@pytest.fixture(scope="module")
def trained(spark, files):
    features = flows.train_features(SRC.read_csv(spark, files[0]), TYPES, priority=[DELAY])
    return features, flows.train_flow(features.table, PARAMS, rounds=8)


def test_features(trained):
    features, _ = trained
    cols = features.table.columns
    assert features.redundant == [(BRACKET, DELAY)] and BRACKET not in cols
    assert [(d.dropped, d.kept) for d in features.collinear if PRICE in (d.kept, d.dropped)] == [(PRICE_COPY, PRICE)]
    assert f"{OPTIONS}__NO_OPTIONS" in cols and OPTIONS not in cols
    assert features.table.count() == 400


def test_training(trained):
    _, t = trained
    assert t.train.where(F.col("nps_class") == -1).count() == 0
    assert t.train.count() + t.test.count() == 392
    assert t.train.agg(F.max("npsDate")).first()[0] <= t.test.agg(F.min("npsDate")).first()[0]
    assert 0.0 < t.threshold < 1.0
    assert not {*S.META_COLS, "label"} & set(t.classifier.matrix.layout.columns)


def test_live_scoring_covers_all_active_customers(spark, files, trained):
    features, t = trained
    eav = SRC.read_csv(spark, files[1])
    ready = flows.live_features(eav, TYPES, features.vocabulary)
    scored = flows.score_live(ready, t.classifier)
    assert scored.count() == 60 and scored.where("p between 0 and 1").count() == 60
    everyone = flows.live_features(eav, TYPES, features.vocabulary, active_only=False)
    assert everyone.count() == 300
    # the full pivot filtered to active customers gives the same rows
    again = everyone.where(F.col(S.SEVERE_FLAG_COL).isNotNull()).select(*ready.columns)
    assert again.exceptAll(ready).count() == 0


def test_inactive_cohort(spark, files, trained):
    features, _ = trained
    everyone = flows.live_features(SRC.read_csv(spark, files[1]), TYPES, features.vocabulary, active_only=False)
    idle = everyone.where(F.col(S.SEVERE_FLAG_COL).isNull())
    recent = [c for c in columns_with(idle.columns, S.WINDOW_SUFFIX) if "__" not in c]
    assert set(recent) == {DELAY, BRACKET, PRICE_COPY}
    travel = columns_with(recent, *S.TRAVEL_KEYWORDS)
    assert {r["pct_null"] for r in null_counts(idle, travel).collect()} == {100.0}
    found = {r["cohort"]: r["n"] for r in cohorts(idle, [*recent, PRICE]).collect()}
    assert found == {"partial": 60, "pure_inactive": 180}
    pure, partial = split_by_activity(idle, [*recent, PRICE])
    assert (pure.count(), partial.count()) == (180, 60)


def test_counterfactual(spark, files, trained):
    features, t = trained
    ready = flows.live_features(SRC.read_csv(spark, files[1]), TYPES, features.vocabulary)
    outcome, lever, explainer = flows.counterfactual_flow(spark, ready, t.classifier, lever=DELAY)
    s = outcome.summary.first()
    assert s["n"] == 60 and s["ate"] > 0
    assert lever.first()["new_lever"] not in S.INTERVENTION_COLS
    assert outcome.attributed.count() == 60 and len(explainer.trees) == 8


def test_stream_scores_like_the_batch(spark, files, trained, tmp_path):
    features, t = trained
    wide = load_wide(SRC.read_csv(spark, files[1]), TYPES).repartition(4)
    wide.write.parquet(str(tmp_path / "in"))
    wide = spark.read.parquet(str(tmp_path / "in"))

    def run():
        stream = read_wide_stream(spark, str(tmp_path / "in"), wide.schema, files_per_batch=1)
        scored = score_stream(stream, features.vocabulary, t.classifier)
        query = write_scores(scored.select("sourceId", "p"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    ready = flows.live_features(SRC.read_csv(spark, files[1]), TYPES, features.vocabulary)
    want = flows.score_live(ready, t.classifier).select("sourceId", "p")
    assert run().exceptAll(want).count() == 0
    assert run().count() == want.count() == 60
    # a second run takes only the files that came since
    wide.limit(300).withColumn("sourceId", F.concat(F.lit("later-"), "sourceId")).write.mode("append").parquet(str(tmp_path / "in"))
    assert run().count() == 120


def test_semi_join_spreads_a_hot_entity(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.concat(F.lit("e"), F.col("id"))).alias("sourceId"),
        F.lit("k").alias("driverKey"), F.lit("v").alias("value"), F.col("id").alias("ord"),
    )
    kept = active_history(rows, "k")
    assert kept.count() == 9000 and kept.columns == rows.columns
    # neither a broadcast nor the merging of small partitions may hide the placement
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        keys = rows.select("sourceId").distinct()
        placed = join_distinct(rows, keys, "sourceId").groupBy(F.spark_partition_id().alias("p"), "sourceId").count()
        assert placed.where("sourceId = 'hot'").count() > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
