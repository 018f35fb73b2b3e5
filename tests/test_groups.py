"""Group operators against brute force, with a group that holds a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from purser.operators import features, groups, repair


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows, a third of them in one group; many small ones; a missing key."""
    draw = random.Random(3)
    data = []
    for i in range(900):
        group = "big" if i % 3 == 0 else "mid" if i % 7 == 0 else None if i % 8 == 1 else f"g{draw.randrange(200)}"
        value = None if draw.random() < 0.4 else draw.choice("ABC")
        if group and group.startswith("g"):
            value = value and draw.choice("AAAAB")
        data.append((f"{i:05d}", group, value, draw.randrange(50), draw.randrange(10)))
    return spark.createDataFrame(data, "id string, g string, v string, a int, b int").repartition(5).cache()


def members(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        out.setdefault(r["g"], []).append(r)
    return out


def test_propagate(skewed):
    """A dict filled from the distinct pairs in first-seen order: later pairs overwrite earlier ones."""
    value = {}
    for g, own in members(skewed).items():
        value[g] = None if g is None else (list(dict.fromkeys(r["v"] for r in own if r["v"])) or [None])[-1]
    expected = sorted((r["id"], value[r["g"]]) for r in skewed.collect())
    for out in (repair.propagate_group_value(skewed, "g", ["v"], "id"), repair.lookup_overwrite(skewed, "g", "v", "id")):
        assert out.columns == skewed.columns
        assert sorted((r["id"], r["v"]) for r in out.collect()) == expected


def test_fill_if_unique_and_semi(skewed):
    known = {g: {r["v"] for r in own if r["v"]} for g, own in members(skewed).items()}
    only = {g: next(iter(v)) if g is not None and len(v) == 1 else None for g, v in known.items()}
    out = repair.fill_if_unique(skewed, "g", "v")
    assert sorted((r["id"], r["v"]) for r in out.collect()) == sorted(
        ((r["id"], r["v"] or only[r["g"]]) for r in skewed.collect()))
    semi = repair.semi_single_valued(skewed, "g", "v")
    assert rows(semi) == rows(skewed.where(F.col("g").isin([g for g, v in only.items() if v])))


def test_group_features(skewed):
    df = skewed.withColumnsRenamed({"g": "GroupNumber"}).withColumn("InGroupNumber", F.lpad("b", 2, "0"))
    sized = features.group_features(df)
    assert sized.count() == 900
    assert rows(features.join_group_features(df)) == rows(sized.where("GroupNumber IS NOT NULL"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join(skewed, how):
    lookup = skewed.where("v = 'A'").groupBy("g").agg(F.count("v").alias("n")).where("g <> 'mid'")
    out = groups.lookup_join(skewed, lookup, "g", how)
    assert rows(out) == rows(skewed.join(lookup, "g", how).select(*skewed.columns, "n"))


def test_number_rows(skewed):
    known = skewed.where("g IS NOT NULL")
    out = groups.number_rows(known, "g", ("a", "b", "id"), F.floor(F.col("a") / 7))
    got = {r["id"]: r["member"] for r in out.collect()}
    for g, own in members(known).items():
        ordered = sorted(own, key=lambda r: (r["a"], r["b"], r["id"]))
        assert [got[r["id"]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_distinct_values_of_one_group_take_linear_time(spark):
    """Two hundred thousand distinct values in a group: an aggregate of them, no list that each row repeats."""
    df = spark.range(200_000).selectExpr("cast(1 as int) g", "cast(id as string) v", "id ord")
    assert repair.propagate_group_value(df, "g", ["v"], "ord").select("v").distinct().collect() == [("199999",)]


def test_no_task_holds_the_group(spark, tmp_path):
    """Half the rows in one group: their side of the join is split."""
    previous = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(100_000).repartition(8).selectExpr(
            "if(id % 2 = 0, 'big', cast(id as string)) g", "cast(xxhash64(id) as string) v", "id ord").withColumn("pad", F.sha2("v", 512))
        out = repair.fill_if_unique(df, "g", "v").withColumn("task", F.spark_partition_id())
        out.write.parquet(str(tmp_path / "out"))
        largest = spark.read.parquet(str(tmp_path / "out")).where("g = 'big'").groupBy("task").count().agg(F.max("count")).first()[0]
        assert largest < 25_000
    finally:
        for k in settings:
            spark.conf.set(k, previous[k]) if k in previous else spark.conf.unset(k)
