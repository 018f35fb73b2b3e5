"""A manifest derived from the order tables, with missing values put in by rule.

An order is a travel group and its line items are the members. Only the tables
behind the requested columns are read: without Age, for example, ``part`` is never
joined. The lookups are left joins on primary keys, so leaving one out changes no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from purser.functions.scalars import SPEND
from purser.operators.groups import number_rows
from purser.sources.manifest import LABEL, TRAIN_SCHEMA

# A column is missing where l_partkey is a multiple of its number.
MISSING_EVERY = {
    "HomePlanet": 11,
    "CryoSleep": 23,
    "Cabin": 13,
    "Destination": 17,
    "Age": 7,
    "VIP": 19,
    "RoomService": 29,
    "FoodCourt": 31,
    "ShoppingMall": 37,
    "Spa": 41,
    "VRDeck": 43,
    "Name": 47,
}
MEMBER_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
SPLITS = ("train", "score")
PARTS_IN_SLOT = 4_096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(number: str, width: int) -> Column:
    digits = F.col(number).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def _values() -> dict[str, Column]:
    asleep = F.col("l_discount") <= 0.02
    deck = F.substring(F.lit("ABCDEFGT"), (F.col("l_suppkey") % 8 + 1).cast("int"), F.lit(1))
    side = F.when(F.col("l_orderkey") % 2 == 0, "P").otherwise("S")
    spend = {
        "RoomService": F.col("l_quantity"),
        "FoodCourt": F.col("l_partkey") % 500,
        "ShoppingMall": F.col("l_suppkey"),
        "Spa": F.floor(F.col("l_extendedprice") / 100),
        "VRDeck": F.col("l_orderkey") % 97,
    }
    planet = F.col("o_custkey") % 3
    return {
        "HomePlanet": F.when(planet == 0, "Earth").when(planet == 1, "Europa").when(planet == 2, "Mars"),
        "CryoSleep": asleep,
        "Cabin": F.concat(deck, F.lit("/"), F.col("l_suppkey").cast("string"), F.lit("/"), side),
        "Destination": F.when(F.col("l_returnflag") == "A", "TRAPPIST-1e")
        .when(F.col("l_returnflag") == "N", "DEST-N")
        .when(F.col("l_returnflag") == "R", "DEST-R"),
        "Age": F.col("p_size").cast("double"),
        "VIP": F.col("l_tax") == 0,
        **{c: F.when(asleep, 0.0).otherwise(spend[c].cast("double")) for c in SPEND},
        "Name": F.col("c_name"),
        LABEL: F.col("l_linestatus") == "F",
    }


def manifest(
    spark: SparkSession,
    sf_dir: str,
    *columns: str,
    split: str | None = None,
    key: bool | str = True,
) -> DataFrame:
    """PassengerId and the given columns (all when none are given) of the derived manifest.

    ``split`` keeps the training or the scoring part; whole orders go to either. Without
    ``key`` no members are numbered, which saves the shuffle of the line items; with ``key="group"``
    they are not either, and the rows have their GroupNumber alone.
    """
    columns = columns or tuple(f.name for f in TRAIN_SCHEMA.fields[1:])
    rows = table(spark, sf_dir, "lineitem")
    if split == "train":
        rows = rows.where(F.col("l_orderkey") % 5 != 0)
    elif split == "score":
        rows = rows.where(F.col("l_orderkey") % 5 == 0)
    elif split is not None:
        raise ValueError(f"split is one of {SPLITS}, not {split}")
    if "Age" in columns:
        # A part's sizes as one array, unfolded after the numbering: should a key repeat, the numbers don't depend on it.
        part = table(spark, sf_dir, "part").where("p_partkey is not null").groupBy(F.col("p_partkey").alias("l_partkey"))
        rows = rows.join(part.agg(F.collect_list(F.struct("p_size")).alias("sizes")), "l_partkey", "left")
    if key is True:
        slot = F.col("l_linenumber").cast("bigint") * F.lit(1 << 40) + F.floor(F.col("l_partkey") / PARTS_IN_SLOT)
        rows = number_rows(rows, "l_orderkey", MEMBER_ORDER, slot)
    if {"HomePlanet", "Name"} & set(columns):
        orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        if "Name" in columns:  # the orders are fewer than their lines
            customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
            orders = orders.join(customer, "o_custkey", "left")
        rows = rows.join(orders, "l_orderkey", "left")
    if "Age" in columns:
        rows = rows.select("*", F.inline_outer("sizes"))
    values = _values()
    for name, every in MISSING_EVERY.items():
        values[name] = F.when(F.col("l_partkey") % every != 0, values[name])
    group = _padded("l_orderkey", 7)
    named = []
    if key:
        named = [group.alias("GroupNumber") if key == "group" else F.concat(group, F.lit("_"), _padded("member", 2)).alias("PassengerId")]
    return rows.select(*named, *[values[c].alias(c) for c in columns])
