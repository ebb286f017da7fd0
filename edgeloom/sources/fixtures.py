"""Graphs derived from the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hashed contacts per customer, both orientations."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("a"))
    n = people.count()
    picks = people.select("a", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("a", F.expr(f"(((a * 2654435761 + k * 40503) % 4294967296) div 7) % {n}").alias("b"))
    return picks.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").distinct()


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal: a user's event leads to the user of the next event in time; errors delete.

    The next event is found within ranges of event ids plus one carried edge row, so no global sort is needed: event ids
    are dense and ordered as the times are.
    """
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("src"), "event_type", "value", "ts")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("src").alias("dst"))
    return e.join(after, "event_id").select("src", "dst", (F.col("event_type") == "error").alias("del"), F.expr("case when event_type = 'error' then -1 when event_type = 'view' then null else 1 end").cast("int").alias("op"), F.col("value").cast("double").alias("weight"), F.col("event_id").alias("ver"), "ts")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part and its supplier, for every line item; the graph drops repeats."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).dropna()


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c, base=0: (F.lit(base) + F.col(c)).cast("long")
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    out = n.select(long("n_regionkey").alias("src"), long("n_nationkey", 100).alias("dst"))
    out = out.unionByName(c.select(long("c_nationkey", 100).alias("src"), long("c_custkey", 1000000).alias("dst")))
    return out.unionByName(s.select(long("s_nationkey", 100).alias("src"), long("s_suppkey", 2000000).alias("dst")))
