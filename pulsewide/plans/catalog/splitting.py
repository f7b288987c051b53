"""Split and sample queries."""

from __future__ import annotations

from pulsewide.operators import split as SP
from pulsewide.plans import views as V
from pulsewide.plans.catalog.ingest import _OOT
from pulsewide.plans.catalog.registry import EAV, FEATURES, query
from pulsewide.sources.eav import sample_entities


def _dated(spark, sf_dir):
    return V.orders(spark, sf_dir).select("row_id", "obs_date")


@query("l1_oot_split", f"WITH {FEATURES}, {_OOT} SELECT row_id, obs_date, is_train FROM parted")
def l1_oot_split(spark, sf_dir):
    return SP.oot_mark(_dated(spark, sf_dir), "obs_date", ["row_id"])


@query("l2_folds", f"""
WITH {FEATURES},
o AS (SELECT row_id, obs_date, row_number() OVER (ORDER BY obs_date, row_id) - 1 AS pos, count(*) OVER () AS n FROM order_features)
SELECT row_id, obs_date,
       CAST(CASE WHEN pos < n - 3 * (n // 4) THEN 0 WHEN pos < n - 2 * (n // 4) THEN 1
                 WHEN pos < n - (n // 4) THEN 2 ELSE 3 END AS INTEGER) AS fold
FROM o""")
def l2_folds(spark, sf_dir):
    return SP.expanding_folds(_dated(spark, sf_dir), "obs_date", ["row_id"])


def _hash(seed: int, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 15) AS BIGINT)"


@query("l4_entity_sample", f"WITH {EAV} SELECT * FROM eav WHERE {_hash(42, 'entity_id')} % 4 < 1")
def l4_entity_sample(spark, sf_dir):
    """Whole entities by hash: a sampling operator, so it returns part of the rows."""
    return sample_entities(V.eav(spark, sf_dir), "entity_id", 1, 4)


@query("l5_sample", f"""
WITH {FEATURES} SELECT row_id, obs_date FROM order_features
ORDER BY {_hash(42, 'row_id')}, {_hash(43, 'row_id')} LIMIT 1000""")
def l5_sample(spark, sf_dir):
    """Exactly 1000 rows chosen by a seeded hash, as a filter."""
    return SP.sample_at_most(_dated(spark, sf_dir), ["row_id"], 1000)
