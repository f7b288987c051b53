"""Token encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewide.functions import columns as C
from pulsewide.operators.encode import apply_vocabulary, fit_vocabulary, vocabulary_table
from pulsewide.plans import views as V
from pulsewide.plans.catalog.registry import TOKENS, query

_VOCAB = TOKENS + """,
token_counts AS (
  SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM token_lists) GROUP BY tok),
top_tokens AS (
  SELECT tok, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, tok) AS rk FROM token_counts) WHERE rk <= {k})"""

_CLEAN = "coalesce(nullif(trim(regexp_replace({t}, '[^0-9A-Za-z]+', '_', 'g'), '_'), ''), 'UNK')"


@query("n1_vocab", f"""
WITH {_VOCAB.format(k=7)}
SELECT 'tokens' AS "column", tok AS token, n, CAST(row_number() OVER (ORDER BY tok) - 1 AS INTEGER) AS position,
       'tokens__' || {_CLEAN.format(t='tok')} AS output_name
FROM top_tokens""")
def n1_vocab(spark, sf_dir):
    return vocabulary_table(V.part_tokens(spark, sf_dir), ["tokens"], 7)




@query("n2_indicators", f"""
WITH {_VOCAB.format(k=5)}
SELECT p_partkey, tok AS token, CAST(list_contains(toks, tok) AS TINYINT) AS present
FROM token_lists, top_tokens""")
def n2_indicators(spark, sf_dir):
    """The indicator columns, stacked so that their names are data."""
    parts = V.part_tokens(spark, sf_dir)
    vocabulary = fit_vocabulary(parts, ["tokens"], 5)
    encoded = apply_vocabulary(parts, vocabulary)
    cells = F.array(*[
        F.struct(F.lit(token).alias("token"), F.col(name).alias("present"))
        for _, _, token, name in vocabulary.rows
    ])
    return encoded.select("p_partkey", F.inline(cells))


@query("f1_tokens", f"""
WITH {TOKENS} SELECT p_partkey, array_to_string(list_sort(toks), ',') AS tokens, CAST(len(toks) AS INTEGER) AS n
FROM token_lists""")
def f1_tokens(spark, sf_dir):
    toks = F.array_distinct(C.tokens(F.col("tokens")))
    return V.part_tokens(spark, sf_dir).select(
        "p_partkey", F.array_join(F.array_sort(toks), ",").alias("tokens"), F.size(toks).alias("n")
    )


@query("f2_sanitise", f"""
SELECT doc_id, {_CLEAN.format(t='source')} AS source_name, {_CLEAN.format(t='text')} AS text_name FROM documents""")
def f2_sanitise(spark, sf_dir):
    """Column-safe names of free text, over whole documents."""
    d = V.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", C.sanitise(F.col("source")).alias("source_name"), C.sanitise(F.col("text")).alias("text_name")
    )
