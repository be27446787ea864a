"""Tables of the driver as trajectories, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def events(spark: SparkSession, sf_dir: str, *also: Column) -> DataFrame:
    """A user's events as an episode: frame, length, t (seconds), value, k, kind, done, engaged, linked, and columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select(
        F.col("user_id").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.count("*").over(W.partitionBy("user_id")).alias("length"),
        ((micros - F.first(micros).over(w)) / 1e6).alias("t"), "value", k.alias("k"), F.col("event_type").alias("kind"),
        (F.col("event_type") == "error").alias("done"), F.col("event_type").isin("click", "view").alias("engaged"), F.floor(k / 50).cast("int").alias("linked"), *also,
    )


EVENTS = """
ep AS (SELECT user_id AS episode, row_number() OVER w - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS length,
    (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS t, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
    event_type AS kind, event_type = 'error' AS done, event_type IN ('click', 'view') AS engaged,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) // 50 AS linked
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors as an episode: frame, v (doubles)."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = W.partitionBy("label").orderBy("vec_id")
    return df.select(F.col("label").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))


EMBEDDINGS = """
em AS (SELECT label AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a short episode."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return df.select(F.col("l_orderkey").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"))


ORDERS = """
od AS (SELECT l_orderkey AS episode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS frame,
    CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem)"""
