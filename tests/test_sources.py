import pytest
from pyspark.sql import functions as F

from purser import session
from purser.sources import manifest as io

HEADER = ",".join(f.name for f in io.TRAIN_SCHEMA.fields)


def write(tmp_path, *lines):
    path = tmp_path / "m.csv"
    path.write_text("\n".join((HEADER, *lines)) + "\n")
    return str(path)


def test_scan_types_and_missing(spark, tmp_path):
    path = write(tmp_path, "0001_01,Earth,False,F/1/P,,39.0,True,0.0,NaN,,5.5,1.0,Ann,True")
    row = io.read_manifest(spark, path).first()
    assert (row["CryoSleep"], row["VIP"], row["Transported"]) == (False, True, True)
    assert row["Destination"] is None and row["FoodCourt"] is None and row["ShoppingMall"] is None
    assert row["Age"] == 39.0 and row["Spa"] == 5.5


def test_malformed_value_stops_the_scan(spark, tmp_path):
    path = write(tmp_path, "0001_01,Earth,maybe,F/1/P,X,39.0,True,0.0,0.0,0.0,0.0,1.0,Ann,True")
    with pytest.raises(Exception, match="MALFORMED|maybe"):
        io.read_manifest(spark, path).collect()
    assert io.read_manifest(spark, path, mode="PERMISSIVE").first()["CryoSleep"] is None


def test_nan_becomes_null_before_any_mean(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "x double")
    assert io.nan_to_null(df).agg(F.avg("x"), F.count("x")).first() == (2.0, 1)


def test_submission_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([("0001_01", 1), ("0002_01", 0)], "PassengerId string, prediction int")
    path = str(tmp_path / "submission")
    io.write_submission(io.submission(scored), path)
    io.write_submission(io.submission(scored), path)
    back = spark.read.csv(path, header=True)
    assert back.columns == ["PassengerId", "Transported"]
    assert sorted(map(tuple, back.collect())) == [("0001_01", "true"), ("0002_01", "false")]


def test_written_tables_go_to_the_configured_folder(spark):
    df = session.written(spark.range(10), "t")
    assert sorted(r["id"] for r in df.collect()) == list(range(10))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == folder
    assert folder in df.inputFiles()[0]


def test_small_table(spark):
    schema = "a string, b boolean, c double, n bigint"
    values = [("x", True, 1.0, 1), ("y", None, None, 2)]
    assert list(map(tuple, session.small_table(spark, values, schema).collect())) == values
    empty = session.small_table(spark, [(None, None, None, None)], schema)
    assert empty.first() == (None, None, None, None) and empty.dtypes[1] == ("b", "boolean")
    assert session.small_table(spark, [], schema).count() == 0
