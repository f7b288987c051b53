import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.functions import columns as C
from pulsewide.operators import encode as N

CELLS = [
    ("a&b||x",), ("a/b|| x ||x",), ("\ta&b\t||a/b",), ("||",), ("  ",), (None,), (None,), ("x",), ("",), ("&&",),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(i, c[0], c[0]) for i, c in enumerate(CELLS)], "id int, t string, u string")


def test_tokens(df):
    got = [sorted(set(r["y"])) for r in df.orderBy("id").select(C.tokens(F.col("t")).alias("y")).collect()]
    assert got == [["a&b", "x"], ["a/b", "x"], ["a&b", "a/b"], [], [], ["NO_OPTIONS"], ["NO_OPTIONS"], ["x"], [], ["&&"]]


def test_vocabulary_counts_rows_and_breaks_ties_by_token(df):
    rows = {r["token"]: (r["n"], r["position"], r["output_name"]) for r in N.vocabulary_table(df, ["t"], 10).collect()}
    assert rows == {
        "&&": (1, 0, "t__UNK"),
        "NO_OPTIONS": (2, 1, "t__NO_OPTIONS"),
        "a&b": (2, 2, "t__a_b"),
        "a/b": (2, 3, "t__a_b_2"),
        "x": (3, 4, "t__x"),
    }
    top = N.fit_vocabulary(df, ["t"], 3)
    assert [r[2] for r in top.rows] == ["NO_OPTIONS", "a&b", "x"]


def test_transform_replaces_columns_in_order(df):
    out, vocabulary = N.encode_tokens(df, ["t", "u"], 2)
    assert out.columns == ["id", "t__NO_OPTIONS", "t__x", "u__NO_OPTIONS", "u__x"]
    assert out.schema["t__x"].dataType == T.ByteType()
    assert [r["t__x"] for r in out.orderBy("id").collect()] == [1, 1, 0, 0, 0, 0, 0, 1, 0, 0]
    assert vocabulary.output_columns == {"t": ["t__NO_OPTIONS", "t__x"], "u": ["u__NO_OPTIONS", "u__x"]}


def test_fitted_vocabulary_is_reused(spark, df, tmp_path):
    _, vocabulary = N.encode_tokens(df, ["t", "u"], 2)
    vocabulary.save(spark, str(tmp_path / "v"))
    back = N.Vocabulary.load(spark, str(tmp_path / "v"))
    assert back == vocabulary
    live = spark.createDataFrame([(1, "new||x"), (2, "new")], "id int, t string")
    out, _ = N.encode_tokens(live, [], vocabulary=back)
    # the absent column is skipped and an unknown token sets nothing
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0, 1), (2, 0, 0)]


def test_missing_column_at_fit(df):
    with pytest.raises(KeyError):
        N.fit_vocabulary(df, ["absent"])


def test_redundant_columns(spark):
    bracket = "transactionalTravelTripDelayDurationBracketV0Last30d"
    df = spark.createDataFrame([("x", 1.0)], f"{bracket} string, other double")
    kept, report = N.drop_redundant(df)
    assert kept.columns == ["other"]
    assert report == [(bracket, "transactionalTravelTripAverageDelayDurationV0Last30d")]
    same, none = N.drop_redundant(kept)
    assert same.columns == ["other"] and none == []
