"""Episode views over plain tables: frames (episode_index, step, t, features) from events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order; t is hours since the first, from whole microseconds; action is the value."""
    # named before the windows, so that their partitioning is known by the name that all signals use
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_index"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    user = Window.partitionBy("episode_index")
    step = F.row_number().over(user.orderBy("us", "event_id")) - 1
    return e.select("episode_index", step.alias("step"), ((F.col("us") - F.min("us").over(user)) / 3.6e9).alias("t"), F.array("value").alias("action"))


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items in a total order; twenty steps a second; action has three dimensions, state one."""
    item = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "episode_index")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    step = F.row_number().over(Window.partitionBy("episode_index").orderBy(*order)) - 1
    return item.select("episode_index", step.alias("step"), F.array("l_quantity", "l_discount", "l_tax").alias("action"), F.array(F.col("l_extendedprice") / 1000).alias("state"), F.col("l_tax").alias("penetration")).withColumn("t", F.col("step") / 20)


def document_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as episodes: n_chars is the length, language and source are tasks, quality is a label that may be unknown."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(q, "doc_id", "left").select(F.col("doc_id").alias("episode_index"), F.col("n_chars").alias("n_steps"), F.array("lang", "source").alias("tasks"), (F.col("quality") == 1).alias("success"), (F.col("toxic") == 1).alias("toxic"), "lang", "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("episode_index"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
