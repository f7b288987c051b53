import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide import schema as S
from pulsewide.functions import columns as C
from pulsewide.operators import pivot as PV
from pulsewide.plans import views as V
from pulsewide.sources import eav as SRC


def one_column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def column(df, name="y"):
    return [r[name] for r in df.collect()]


def test_float_parsing(spark):
    texts = ["", "abc", " 1.5 ", "1.5f", "1d", "inf", "NaN", "1e3", "1,5", "-2.5", ".5", "7.", "1e39", None]
    got = column(one_column(spark, texts).select(C.to_float(F.col("x")).alias("y")))
    assert got == [None] * 7 + [1000.0, None, -2.5, 0.5, 7.0, None, None]


def test_date_and_score_parsing(spark):
    texts = ["2024-05-01T10:00:00Z", "2024-05-01", "2024-13-01", "2024-5", "bad", "", None]
    got = column(one_column(spark, texts).select(C.to_date(F.col("x")).cast("string").alias("y")))
    assert got == ["2024-05-01", "2024-05-01", None, None, None, None, None]
    got = column(one_column(spark, ["0", "7", "10", "300", "7.0", "", None]).select(C.to_tiny(F.col("x")).alias("y")))
    assert got == [0, 7, 10, None, None, None, None]


def test_class_of_score(spark):
    df = spark.createDataFrame([(0,), (7,), (10,), (5,), (None,)], "s tinyint")
    out = df.select(C.score_class(F.col("s")).alias("y"))
    assert column(out) == [0, 1, 2, -1, -1]
    assert out.schema["y"].dataType == T.ByteType()


def test_severity_flag(spark):
    df = spark.createDataFrame([(None,), (10.0,), (10.1,), (0.0,)], "d float")
    out = PV.add_severe_flag(df, 10.0, "d", "f")
    assert column(out, "f") == [None, 0, 1, 0]
    assert out.schema["f"].dataType == T.ByteType()
    with pytest.raises(KeyError):
        PV.add_severe_flag(df, 10.0, "absent")


TRAIN = [
    # customer 1: empty first value wins over a later one; a repeated key keeps the first
    ("1", "a", "2024-01-02T00:00:00Z", "0", "num", ""),
    ("1", "a", "2024-01-02T00:00:00Z", "0", "num", "5"),
    ("1", "a", "2024-01-02T00:00:00Z", "0", "cat", "red"),
    ("1", "a", "2024-01-02T00:00:00Z", "0", "cat", "blue"),
    # customer 2: text that is no number, an unknown key
    ("2", "b", "bad date", "x", "num", "n/a"),
    ("2", "b", "bad date", "x", "mystery", ""),
    # customer 3: only an unknown key
    ("3", "c", "2024-02-01", "10", "mystery", "m"),
]
TYPES = {"num": S.NUMERIC, "cat": S.CATEGORICAL, "never": S.NUMERIC}


def write_csv(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join(r) for r in rows]]) + "\n")
    return str(path)


def test_csv_round_trip_and_pivot(spark, tmp_path):
    path = write_csv(tmp_path / "train.csv", S.TRAIN_EAV.names, TRAIN)
    raw = SRC.read_csv(spark, path)
    assert all(f.dataType == T.StringType() for f in raw.schema if f.name != "ord")
    assert raw.schema["ord"].dataType == T.LongType()
    wide = PV.load_wide(raw, TYPES, keep_unknown=True)
    rows = {r["sourceId"]: r.asDict() for r in wide.collect()}
    assert rows["1"]["num"] is None and rows["1"]["cat"] == "red"
    assert str(rows["1"]["npsDate"]) == "2024-01-02" and rows["1"]["npsScore"] == 0
    assert rows["2"]["num"] is None and rows["2"]["npsDate"] is None and rows["2"]["npsScore"] is None
    assert rows["3"]["mystery"] == "m" and rows["3"]["never"] is None
    assert wide.schema["num"].dataType == T.FloatType()


def test_score_column_is_optional(spark, tmp_path):
    rows = [r[:3] + r[4:] for r in TRAIN]
    raw = SRC.read_csv(spark, write_csv(tmp_path / "live.csv", S.LIVE_EAV.names, rows))
    assert PV.index_columns(raw) == S.ID_COLS
    assert S.SCORE_COL not in PV.load_wide(raw, TYPES).columns


def test_first_follows_file_order_across_files_and_splits(spark, tmp_path):
    for part in range(3):
        rows = [("1", "a", "2024-01-01", "0", f"k{i}", str(part * 1000 + i)) for i in range(300)]
        write_csv(tmp_path / f"part{part}.csv", S.TRAIN_EAV.names, rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        types = {f"k{i}": S.NUMERIC for i in range(0, 300, 50)}
        row = PV.load_wide(SRC.read_csv(spark, str(tmp_path)), types).first()
        one = SRC.read_csv(spark, str(tmp_path / "part1.csv"))
        ordered = [r["value"] for r in one.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [row[k] for k in types] == [float(i) for i in range(0, 300, 50)]
    assert ordered == [str(1000 + i) for i in range(300)]


def test_csv_quotes_and_column_order(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('sourceId,value\n1,"a ""b"", c"\n2,"x, y"\n3,plain\n')
    got = {r["sourceId"]: r["value"] for r in SRC.read_csv(spark, str(good)).collect()}
    assert got == {"1": 'a "b", c', "2": "x, y", "3": "plain"}
    both = tmp_path / "both"
    both.mkdir()
    (both / "a.csv").write_text("sourceId,value\n1,x\n")
    (both / "b.csv").write_text("value,sourceId\ny,2\n")
    with pytest.raises(Exception, match="header|Header|HEADER"):
        SRC.read_csv(spark, str(both)).collect()


def test_pivot_of_several_files_is_a_hash_aggregation(spark, tmp_path):
    for part in range(2):
        write_csv(tmp_path / f"part{part}.csv", S.TRAIN_EAV.names, [("1", "a", "2024-01-01", "0", "num", str(part))])
    raw = SRC.read_csv(spark, str(tmp_path))
    assert raw.schema["ord"].dataType == T.LongType()
    wide = PV.pivot_first(raw, {"num": S.NUMERIC}, S.ID_COLS)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert wide.first()["num"] == 0.0


def test_too_many_unknown_keys_are_an_error(spark):
    raw = spark.createDataFrame([(f"k{i}",) for i in range(5)], "driverKey string")
    with pytest.raises(ValueError, match="not in the definitions"):
        PV.extra_keys(raw, ["k0"], most=3)


def test_definitions(spark, tmp_path):
    path = tmp_path / "defs.csv"
    path.write_text("key,driverType,dataType\nnum,Travel,numeric\ncat,Basket,categorical\nodd,Basket,blob\nm,X,multi_categorical\n")
    with pytest.warns(UserWarning, match="odd"):
        types, unknown = SRC.read_definitions(spark, str(path))
    assert types == {"num": "numeric", "cat": "categorical", "m": "multi_categorical"}
    assert [r["key"] for r in unknown.collect()] == ["odd"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SRC.read_definitions(spark, str(tmp_path / "absent.csv"))


def test_numeric_pivot_is_one_hash_aggregation(spark, sf):
    plan = V.wide(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_unused_drivers_are_not_aggregated(spark, sf):
    plan = V.wide(spark, sf).select("entity_id", "click")._jdf.queryExecution().optimizedPlan().toString()
    assert "signup" not in plan


def test_landing_keeps_rows_and_sorts_by_key(spark, sf, tmp_path):
    rows = V.eav(spark, sf).withColumnsRenamed({"attr_key": "driverKey", "raw_value": "value", "entity_id": "sourceId"})
    SRC.land(rows, str(tmp_path / "landed"))
    back = SRC.read_parquet(spark, str(tmp_path / "landed"), ["sourceId", "driverKey", "value"])
    assert back.exceptAll(rows.select(back.columns)).count() == 0
    assert back.count() == rows.count()


def test_entity_sample_keeps_whole_entities(spark, sf):
    rows = V.eav(spark, sf)
    kept = SRC.sample_entities(rows, "entity_id", 1, 3)
    whole = rows.join(kept.select("entity_id").distinct(), "entity_id", "left_semi")
    assert 0 < kept.count() < rows.count()
    assert kept.count() == whole.count()
    with pytest.raises(ValueError):
        SRC.sample_entities(rows, "entity_id", 0, 3)


def test_write_table_by_partition(spark, sf, tmp_path):
    wide = V.wide(spark, sf)
    SRC.write_table(wide, str(tmp_path / "wide"), by="nps_class")
    assert spark.read.parquet(str(tmp_path / "wide")).count() == wide.count()
